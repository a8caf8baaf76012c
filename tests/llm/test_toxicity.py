import re
import random

import numpy as np
import pytest

from rillflow.llm import toxicity
from tests.llm.helpers import CLASH, documents, odd_rows, prose

BAD = ["blargh", "gronkish", "vexpuke", "snottle"]


def corpus(n: int = 600, seed: int = 0):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(seed * 10_000 + i, r.randint(20, 80)).split()
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(max(2, len(words) // 12)):
                words[r.randrange(len(words))] = r.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, toxic))
    return rows, labels


def auc(scores, labels) -> float:
    s, y = np.array(scores), np.array(labels)
    return float(np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]))


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    return toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy_and_misspellings(model):
    rows, labels = corpus(300, 1)
    one = toxicity.scorer(model)
    assert auc([one(t) for _, t in rows], [y for *_, y in labels]) > 0.97
    misspelt = [t.replace("blargh", "blarghh").replace("gronkish", "gronkisch").replace("vexpuke", "vexpukes").replace("snottle", "snottles") for _, t in rows]
    assert auc([one(t) for t in misspelt], [y for *_, y in labels]) > 0.9


def test_odd_rows_and_clean(spark, model):
    docs = documents(spark, [*odd_rows(), (50, " ".join(BAD * 5))])
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= x["score"] <= 1 for x in got)
    kept = toxicity.clean(docs, model)
    assert kept.schema == docs.schema
    ids = [x["doc_id"] for x in kept.collect()]
    assert 50 not in ids and {1, 2, 3, 9} <= set(ids) and ids.count(5) == 2 and None in ids


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = corpus(200, 2)
    docs = documents(spark, rows)
    import zlib

    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    models = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    assert np.array_equal(models[0].table, models[1].table) and models[0].bias == models[1].bias


def test_without_labels(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (empty, odd):
        m = toxicity.fit(docs, labels, held_out=False)
        assert all(x["score"] < 0.01 for x in toxicity.score(docs, m).collect())
    assert toxicity.score(documents(spark, []), m).count() == 0


def test_gradient_step_lowers_the_loss():
    rows, labels = corpus(100, 3)
    s = toxicity.Settings(min_texts=2)
    m = toxicity.train(((t, y) for (_, t), (*_, y) in zip(rows, labels, strict=True)), s)
    one = toxicity.scorer(m)
    assert auc([one(t) for _, t in rows], [y for *_, y in labels]) > 0.99
    assert CLASH  # the columns above are carried through


def test_scores_equal_plain_ones(spark):
    """Long words too: every n-gram counts, in a text of one run of 30,000 letters as in any other."""
    import math

    import numpy as np
    import xxhash

    s = toxicity.Settings(buckets=1 << 10)
    model = toxicity.Model(np.random.default_rng(1).normal(0, 3, s.buckets).astype(np.float32), -0.3, s)

    def plain_score(text):
        total, found = 0.0, re.findall(r"[^\W_]+", (text or "").lower())
        for w in found:
            marked = "<" + w + ">"
            pieces = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
            rows = [xxhash.xxh32_intdigest(g, s.seed) % s.buckets for g in pieces]
            total += sum(float(model.table[r]) for r in rows) / len(rows)
        return 1 / (1 + math.exp(-(model.bias + (total / len(found) if found else 0))))

    docs = [*odd_rows(), (50, "x" * 65 + " " + "ab" * 40), (51, "a_b, Cd!")]
    got = {(str(x["doc_id"]), round(x["score"], 6)) for x in toxicity.score(documents(spark, docs), model).collect()}
    assert got == {(str(i), round(plain_score(t), 6)) for i, t in docs}


def test_the_fit_works_in_pieces(monkeypatch):
    """What the fit holds for each line is bounded, and pieces give the same numbers."""
    import tracemalloc

    r, n = np.random.default_rng(3), 400_000
    doc = np.sort(r.integers(0, 500, n)).astype(np.int32)
    gram = r.integers(0, 5000, n).astype(np.int32)
    share = r.random(n, np.float32) / 800
    y = (np.arange(500) % 2).astype(np.float32)
    scale = np.where(np.arange(1 << 13) % 3 == 0, 0, r.random(1 << 13))
    m = scale[gram] > 0
    lines = (doc[m], gram[m], share[m])
    fit = lambda: toxicity.descend(*lines, y, scale, 5, 2.0, 1e-3, toxicity.Settings(buckets=1 << 13))
    monkeypatch.setattr(toxicity, "LINES", n, raising=False)
    whole = fit()
    monkeypatch.setattr(toxicity, "LINES", 10_000, raising=False)
    tracemalloc.start()
    pieces = fit()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(whole[0], pieces[0]) and whole[1] == pieces[1] and whole[0].any()
    assert peak < 40 * m.sum()
    assert np.array_equal(toxicity.summed(gram, share, 1 << 13, np.square), np.bincount(gram, share * share, 1 << 13))


def test_rows_are_kept_in_slices(spark):
    from rillflow.llm.common import SLICE, keep_rows

    def work():
        def each(batch):
            assert 0 < batch.num_rows <= SLICE
            return [i % 3 > 0 for i in batch.column(0).to_pylist()]

        return each

    got = keep_rows(spark.range(3 * SLICE + 5).coalesce(1), work)
    assert [x["id"] for x in got.collect()] == [i for i in range(3 * SLICE + 5) if i % 3]
