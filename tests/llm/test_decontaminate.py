import random

import pytest

from rillflow.llm import decontaminate as d
from tests.llm.helpers import LONG, documents, odd_rows, prose


def sellers(p: str, t: str) -> int:
    before = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        now = [i]
        for j, b in enumerate(t, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def mangle(text: str, edits: int, r: random.Random) -> str:
    x = list(text)
    for _ in range(edits):
        at = r.randrange(len(x))
        x[at : at + r.choice((0, 1))] = r.choice(("", "q"))
    return "".join(x)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(seed):
    r = random.Random(seed)
    items = [(i, d.normal(prose(seed * 100 + i, r.randint(6, 25)))) for i in range(12)]
    match = d.Matcher(items, 0.08)
    for n in range(40):
        i = r.randrange(len(items))
        edits = r.randrange(0, 2 * d.budget(items[i][1], 0.08) + 2)
        text = d.normal(prose(n + 5000, r.randint(0, 30)) + " " + mangle(items[i][1], edits, r) + " " + prose(n + 9000, r.randint(0, 30)))
        want = {j: sellers(p, text) for j, p in items if sellers(p, text) <= d.budget(p, 0.08)}
        got = match(text)
        assert {x[0]: x[1] for x in got} == want
        for j, e, start, end in got:
            assert sellers(dict(items)[j], text[start:end]) == e and abs(end - start - len(dict(items)[j])) <= e


def test_rows(spark):
    items = [(1, prose(77, 30)), (2, None), (3, ""), (1, prose(77, 30)), (None, prose(78, 30)), (4, "tiny")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [(20, LONG + " " + prose(77, 30).upper() + "!! " + LONG), (21, "It is tiny, so."), (22, "destiny tinycal"), (23, prose(78, 30) + prose(77, 30)), (23, prose(78, 30) + prose(77, 30))]
    docs = documents(spark, [*odd_rows(), *texts])
    got = sorted((x["doc_id"], str(x["item_id"]), x["edits"]) for x in d.matches(docs, benchmark).collect())
    assert got == [(20, "1", 0), (21, "4", 0), (23, "1", 0), (23, "1", 0), (23, "None", 0), (23, "None", 0)]
    kept = d.clean(docs, benchmark)
    assert kept.schema == docs.schema
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted([str(i) for i, _ in odd_rows()] + ["22"])
    assert d.matches(documents(spark, []), benchmark).count() == 0
    assert d.clean(docs, benchmark.limit(0)).count() == docs.count()


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CHARS", 150)
    benchmark = spark.createDataFrame([(i, prose(i, 20)) for i in range(8)], "item_id long, text string")
    docs = documents(spark, [(i, f"before {prose(i, 20)} after") for i in range(8)])
    assert sorted((x["doc_id"], x["item_id"]) for x in d.matches(docs, benchmark).collect()) == [(i, i) for i in range(8)]
    assert d.clean(docs, benchmark).count() == 0
