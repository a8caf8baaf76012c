"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import read_table


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm import warc
    from rillflow.llm.common import shared_dir

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(read_table(spark, sf_dir, "pages"), path, segment=16 * 1024)
    return warc.catalogue(spark, path)


def op2_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm import url_filter

    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op3_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm import html_crf

    return html_crf.extract(read_table(spark, sf_dir, "pages"))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm import simhash

    g = simhash.groups(read_table(spark, sf_dir, "documents"), words=4, radius=4)
    return g.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_benchmark_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm import decontaminate

    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm import backoff_lm

    return backoff_lm.score(read_table(spark, sf_dir, "documents"))


def op7_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm import secrets

    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op8_toxicity_subword_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm import toxicity

    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm import sp_dropout

    return sp_dropout.encode(read_table(spark, sf_dir, "documents"))


def op10_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillflow.llm import fuzzy

    return fuzzy.compared(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """For what SQL can express; the tests hold the others against brute force,
    exact round trips or held-out labels."""
    from rillflow.llm import backoff_lm, url_filter

    return {"op2_url_vocabulary": url_filter.sql(), "op6_backoff_scores": backoff_lm.sql()}
