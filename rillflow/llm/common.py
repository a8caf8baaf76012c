"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
SLICE = 256  # rows that a task works on at a time, as a batch of long texts is large already


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset and all
    runs on this machine, as in tests, a temporary folder takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext.getCheckpointDir()
        if not own and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        at = own or tempfile.mkdtemp(prefix="rillflow-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there, so that what
    follows neither plans nor computes the steps before again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_batch(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow where work() prepares a task and returns the function from a
    batch to output columns (name -> list or Arrow array, in schema order)."""
    out_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for some in batches:
            for at in range(0, some.num_rows, SLICE):
                batch = some.slice(at, SLICE)
                cols = each(batch)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip((cols[f.name] for f in arrow), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, out_schema)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, which gives freed memory back to the system at its end: an
    executor's Python workers stay for later tasks, with all that they have not given back."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return each


def text_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch; null counts as empty, broken UTF-8 as U+FFFD."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        for x in column:
            yield (x.as_py() or b"").decode("utf-8", "replace")
    else:
        for x in column:
            yield x.as_py() or ""


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def as_long(unsigned: int) -> int:
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


def mix64(x):
    """The splitmix64 finaliser, on a numpy array of uint64."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", kind: str = "long") -> DataFrame:
    """(node, root) for every node that edges name; root is the smallest node
    that can be reached. kind: the nodes' type.

    Alternates the large-star and small-star steps on the cluster: each step is
    an aggregation by node and a join on it. A node's neighbours are never
    gathered into one row, and as both sides of each join come from files, the
    engine can split a node with very many neighbours over several tasks. Ends when a round changes nothing, after a number of rounds that grows
    with the logarithm of the longest chain.
    """
    e = edges.select(F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e)
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    while True:
        both = e.union(e.select("b", "a"))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        near = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(near, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def keep_rows(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows that work()'s function marks True, with all their columns; a map
    without a shuffle. Rows come and go in slices, as a batch has ten thousand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for some in batches:
            for at in range(0, some.num_rows, SLICE):
                batch = some.slice(at, SLICE)
                yield batch.filter(pa.array(each(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)
