"""Sources: each yields weighted batches until it is exhausted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rillflow.functions.zset import weighted
from rillflow.session import cut

HINTS = {"int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType()}


class Source(Protocol):
    #: what the last batch came from, if that can be read again; it is read once
    origin: str | None
    #: the number of the last row read of an origin that goes on; absent for files
    upto: int

    def batches(self, done=()) -> Iterator[DataFrame]:
        """Without what done, a dict of origins and numbers, says was read. Asking
        for the next batch says that the one before is kept."""

    def close(self) -> None: ...


def origin_of(spark: SparkSession, df: DataFrame) -> str:
    """Names the files that df reads, as they are now: paths, sizes, times."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    seen = []
    for f in sorted(df.inputFiles()):
        at = path(f)
        status = at.getFileSystem(conf).getFileStatus(at)
        seen.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


def schema_of(hints: dict[str, str], header: list[str] | None = None) -> T.StructType:
    """Columns without a hint are strings."""
    names = header or list(hints)
    for h in hints.values():
        if h not in HINTS:
            raise ValueError(f"a type is one of {', '.join(HINTS)}, not {h!r}")
    return T.StructType([T.StructField(n, T.LongType() if n == "__count" else HINTS[hints.get(n, "string")]) for n in names])


class CsvSource:
    """CSV files with a header, read as one batch. A value that does not fit its type
    stops the read. A column __count, if there is one, holds the rows' weights."""

    def __init__(self, spark: SparkSession, path: str, hints: dict[str, str] | None = None):
        self.spark, self.path = spark, path
        header = spark.read.option("header", True).csv(path).columns
        self.schema = schema_of(hints or {}, header)

    def batches(self, done=()) -> Iterator[DataFrame]:
        df = weighted(self.spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(self.schema).csv(self.path))
        self.origin = origin_of(self.spark, df)
        if self.origin not in done:
            yield df

    def close(self) -> None:
        pass


class ParquetSource:
    """Parquet files as one batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = spark.read.parquet(path).schema

    def batches(self, done=()) -> Iterator[DataFrame]:
        df = weighted(self.spark.read.parquet(self.path))
        self.origin = origin_of(self.spark, df)
        if self.origin not in done:
            yield df

    def close(self) -> None:
        pass


class StreamSource:
    """A folder that files arrive in, read by Structured Streaming: with once, what
    is there now, a bounded number of files to a batch, each file once across
    restarts (the engine's checkpoint remembers); else until it is stopped."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, format: str = "json", files: int = 100, interval: str | None = None):
        self.spark, self.path, self.schema, self.format, self.files, self.interval = spark, path, schema, format, files, interval

    def run(self, each, checkpoint: str, once: bool = True):
        """Calls each(batch, number) for every micro-batch; returns the query."""
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files)
        if self.format == "csv":
            reader = reader.option("header", True)
        stream = reader.format(self.format).load(self.path)
        writer = stream.writeStream.foreachBatch(lambda df, n: each(weighted(df), n)).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=self.interval or "1 second")
        return writer.start()

    def close(self) -> None:
        pass


class ChainSource:
    """Sources one after the other; on_error is stop or skip."""

    def __init__(self, sources: list[Source], on_error: str = "stop"):
        if on_error not in ("stop", "skip"):
            raise ValueError("on_error is stop or skip")
        self.sources, self.on_error, self.errors = sources, on_error, []
        self.schema = sources[0].schema if sources else None

    def batches(self, done=()) -> Iterator[DataFrame]:
        for s in self.sources:
            try:
                for batch in s.batches(done):
                    self.origin, self.upto = getattr(s, "origin", None), getattr(s, "upto", 1)
                    if self.on_error == "skip":
                        batch = cut(batch)  # so that what is wrong with it shows here
                    yield batch
            except Exception as e:
                if self.on_error == "stop":
                    raise
                self.errors.append(e)

    def close(self) -> None:
        for s in self.sources:
            s.close()
