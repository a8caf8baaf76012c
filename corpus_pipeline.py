"""A corpus from raw documents to tokens: five stages, each of which works on all
that the one before it kept.

1. toxicity: documents that the subword model scores as toxic go;
2. near copies: of each group of near copies by SimHash, one document stays;
3. decontamination: documents that hold a benchmark passage go;
4. secrets: secrets in the texts are replaced;
5. tokens: the texts are encoded with seeded merge-dropout.

Stages 1 to 4 return the columns of documents. No stage needs more of another
than its rows; each judges its own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import decontaminate, secrets, simhash, sp_dropout, toxicity
from rillflow.llm.common import read_table, shared_dir


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"), held_out=False))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs, words=5, radius=20, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_dropout.encode(docs)


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark),
    ("secret_scan", secret),
    ("sentencepiece", tokens),
]

#: Models, edit matching and hashes have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet
    to the shared folder and read again as the next one's."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
