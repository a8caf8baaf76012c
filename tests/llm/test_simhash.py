import random

import numpy as np
import pytest
import xxhash

from rillflow.llm import simhash
from tests.llm.helpers import LONG, documents, odd_rows, prose


def brute_fingerprint(text: str | None, k: int = 4) -> int:
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    ones = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


@pytest.mark.parametrize("text", ["", " ", "one", "A b C", "a b c d", prose(3), "É é x y z w", LONG[:3000]])
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.hashes(text.encode(), 4)) == brute_fingerprint(text)


def components(links, nodes):
    of = {n: n for n in nodes}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        of[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("radius, chunk", [(4, 1024), (4, 3), (0, 1024), (2, 2)])
def test_links_lose_nothing(spark, radius, chunk):
    r = random.Random(radius)
    fps = set()
    for _ in range(40):  # balls of near fingerprints, and a crowd that shares blocks
        c = r.getrandbits(64)
        for _ in range(6):
            x = c
            for _ in range(r.randrange(radius + 3)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    items = spark.createDataFrame([(s, s) for s in signed], "item long, fp long")
    got = [tuple(x) for x in simhash.links(items, radius, chunk=chunk).collect()]
    want = [(signed[i], signed[j]) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 64 for a, b in got)
    assert components(got, signed) == components(want, signed)


def test_links_of_hot_shards(spark):
    r = random.Random(9)
    fps = {0xABCDEF << 40 | r.getrandbits(24) for _ in range(150)}  # they agree in the blocks of the upper bits
    fps |= {x ^ 1 << r.randrange(24) ^ 1 << r.randrange(24) for x in list(fps)[:60]}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    items = spark.createDataFrame([(s, s) for s in signed], "item long, fp long")
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    want = [(a, b) for a in signed for b in signed if a < b and near(a, b)]
    for chunk in (3, 20):
        got = [tuple(x) for x in simhash.links(items, 4, chunk=chunk).collect()]
        assert components(got, signed) == components(want, signed)
    assert len(set(components(want, signed).values())) > 1


def test_finer_masks():
    for radius in (0, 2, 4):
        for mask in simhash.block_masks(radius):
            parts = [(m & ~mask) & ((1 << 64) - 1) for m in simhash.finer_masks(mask, radius)]
            assert sum(parts) == ~mask & ((1 << 64) - 1) and sum(p.bit_count() for p in parts) == 64 - (mask & ((1 << 64) - 1)).bit_count()


def test_forest_follows_only_edges_within_the_radius():
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    group = np.sort(r.integers(0, 5, 300))
    forest = simhash.build_forest(group, fp)
    found = {(int(q), int(t)) for q, t in ((a, b) for x in simhash.search_forest(forest, fp, fp, group, 26, most=500) for a, b in zip(*x, strict=True))}
    want = {(i, j) for i in range(300) for j in range(300) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 26}
    assert found == want


def test_groups_of_odd_rows(spark):
    got = {}
    for row in simhash.groups(documents(spark, odd_rows())).collect():
        got.setdefault(row["id"], set()).add((row["fp"], row["component"]))
    assert {next(iter(got[i]))[1] for i in (2, 3, 9)} == {2}  # fingerprint zero, linked like any other
    assert next(iter(got[2]))[0] == 0
    assert got[5] == {(next(iter(got[5]))[0], 5)}
    assert next(iter(got[None]))[1] is None  # nothing with an id is linked to it
    assert simhash.groups(documents(spark, [])).count() == 0


def edit(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(x if r.random() > share else f"new{r.random()}" for x in text.split())


def test_dedup_keeps_one_of_each_group(spark):
    rows = [(i, prose(i, 300)) for i in range(30)]
    rows += [(100 + i, prose(i, 300)) for i in range(10)]  # exact copies
    copies = [(200 + i, edit(prose(i, 300), 0.015, i)) for i in range(30)]
    alike = lambda i, t: len(set(simhash.shingles(prose(i, 300).encode(), 5)) & set(simhash.shingles(t.encode(), 5))) / len(set(simhash.shingles(prose(i, 300).encode(), 5)) | set(simhash.shingles(t.encode(), 5)))
    near = [(i, t) for i, t in copies if alike(i - 200, t) >= 0.8]
    assert len(near) > 15
    rows += near
    rows += [(300 + i, prose(i, 60) + " " + prose(1000 + i, 240)) for i in range(10)]  # share a passage only
    rows += [(400, None), (401, ""), (402, LONG)]
    docs = documents(spark, rows)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == [*range(30), *range(300, 310), 400, 402]
    assert simhash.dedup(documents(spark, [])).count() == 0


def test_only_exact_similarity_links(spark):
    """Pairs on either side of 0.8, within the error of the estimate: the sets decide."""
    rows, want = [], set()
    for i in range(60):
        words = prose(i, 300)[:-1].split()
        k = 28 + i % 11  # words that are new at the end: the sets share 296 - k of 296 + k shingles, 0.83 to 0.77
        rows += [(i, " ".join(words)), (1000 + i, " ".join(words[: 300 - k] + [f"n{i}x{j}" for j in range(k)]))]
        one, other = (set(simhash.shingles(t.encode(), 5)) for _, t in rows[-2:])
        if len(one & other) >= 0.8 * len(one | other):
            want.add(1000 + i)
    assert 10 < len(want) < 50
    kept = {r["doc_id"] for r in simhash.dedup(documents(spark, rows)).select("doc_id").collect()}
    assert {i for i, _ in rows} - kept == want
