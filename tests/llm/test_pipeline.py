"""The stages, each on what the one before it kept, against brute force."""

import corpus_pipeline
from rillflow.llm import decontaminate, secrets, simhash, sp_dropout
from tests.conftest import SF
from tests.llm.helpers import documents, odd_rows
from tests.llm.test_secrets import brute


def test_stages_on_real_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r for r in docs.collect()}
    schema, texts = docs.schema, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r["doc_id"]: r for r in docs.collect()}
        assert now.keys() <= before.keys()
        if name != "sentencepiece":
            assert docs.schema == schema
        if name == "simhash_near_dedup":
            sets = {i: set(simhash.shingles(r["text"].encode(), 5)) for i, r in before.items()}
            for i in before.keys() - now.keys():  # what went has a near copy, the group's first stays
                assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in before if j != i) > 0.65
            kept = sorted(now)
            assert all(len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b]) for n, a in enumerate(kept) for b in kept[:n])
        if name == "benchmark_decontamination":
            holds = lambda t: any(decontaminate.normal(b) in decontaminate.normal(t) for b in benchmark)
            assert not [i for i, r in now.items() if holds(r["text"])]
            assert all(holds(before[i]["text"]) for i in before.keys() - now.keys())
        if name == "secret_scan":
            assert now.keys() == before.keys()
            assert all((now[i]["text"] == r["text"]) == (not brute(r["text"])) for i, r in before.items())
            texts = {i: r["text"] for i, r in now.items()}
        if name == "sentencepiece":
            pieces = sp_dropout.Pieces.load()
            assert {i: sp_dropout.decode(pieces, r["pieces"]) for i, r in now.items()} == texts
        else:
            assert now
        before = now if name != "sentencepiece" else before


def test_stages_on_odd_rows(spark):
    docs = documents(spark, odd_rows())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0
        if name != "sentencepiece":
            assert out.schema == docs.schema
            assert stage(spark, docs.limit(0), SF).count() == 0
    assert secrets.KINDS[3] == "random"


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "pieces", "lossless"} <= set(out.columns) and out.where("not lossless").count() == 0
