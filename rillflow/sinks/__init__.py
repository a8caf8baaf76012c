"""Sinks: each writes weighted batches."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillflow.functions.zset import WEIGHT, col, columns, weighted
from rillflow.session import cut

CODECS = ("zstd", "snappy", "gzip", "uncompressed")


class Sink(Protocol):
    def write(self, batch: DataFrame) -> None: ...

    def close(self) -> None: ...


class ConsoleSink:
    """Prints rows as JSON or as text; no more than limit of a batch, and says so."""

    def __init__(self, format: str = "json", limit: int = 1000, out=print):
        self.format, self.limit, self.out = format, limit, out

    def write(self, batch: DataFrame) -> None:
        rows = [r.asDict(recursive=True) for r in weighted(batch).limit(self.limit + 1).collect()]
        more = len(rows) > self.limit
        entries = [{"Tuple": {k: v for k, v in r.items() if k != WEIGHT}, "Count": r[WEIGHT]} for r in rows[: self.limit]]
        self.out(json.dumps(entries, indent=2, default=str) if self.format == "json" else "\n".join(f"{e['Count']:+d} {e['Tuple']}" for e in entries))
        if more:
            self.out(f"... and more than {self.limit} rows")

    def close(self) -> None:
        pass


class JsonSink:
    """JSON lines {"Tuple": {...}, "Count": n}, appended to a folder."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batch: DataFrame) -> None:
        w = weighted(batch)
        w.select(F.struct(*[col(c) for c in columns(w)]).alias("Tuple"), F.col(WEIGHT).alias("Count")).write.mode("append").json(self.path)

    def close(self) -> None:
        pass


class CsvSink:
    """CSV with a header, columns in order of their names, then __count; null is an
    empty field. Later batches keep the first one's columns."""

    def __init__(self, path: str):
        self.path, self.names = path, None

    def write(self, batch: DataFrame) -> None:
        w = weighted(batch)
        self.names = self.names or sorted(columns(w))
        w.select(*[(col(c) if c in w.columns else F.lit(None)).cast("string").alias(c) for c in self.names], WEIGHT).write.mode("append").option("header", True).option("emptyValue", '""').csv(self.path)

    def close(self) -> None:
        pass


class ParquetSink:
    """Parquet files with __count, appended to a folder. With rotate_batches or
    rotate_ms, batches are gathered (in the shared folder) and written together
    after so many, or once so much time has passed. With a cache, all files have the
    schema that the query's first batch had, across restarts."""

    def __init__(self, path: str, compression: str = "zstd", rotate_batches: int = 1, rotate_ms: int | None = None, schema: StructType | None = None, rows_per_file: int | None = None, clock=time.monotonic, cache: Callable[[StructType], StructType] | None = None):
        if compression not in CODECS:
            raise ValueError(f"compression is one of {', '.join(CODECS)}")
        self.path, self.compression, self.every, self.ms, self.schema, self.rows, self.clock = path, compression, max(1, rotate_batches), rotate_ms, schema, rows_per_file, clock
        self.cache = cache
        self.held: list[DataFrame] = []
        self.since = clock()

    def write(self, batch: DataFrame) -> None:
        w = weighted(batch)
        if self.schema is None and self.cache:
            self.schema = self.cache(w.schema)
        if self.schema is not None:  # values that do not fit become null
            w = w.select(*[(col(f.name) if f.name in w.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != WEIGHT], WEIGHT)
        waits = self.every > 1 or self.ms is not None
        self.held.append(cut(w) if waits else w)
        if len(self.held) >= self.every or (self.ms is not None and (self.clock() - self.since) * 1000 >= self.ms):
            self.flush()

    def flush(self) -> None:
        if self.held:
            out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.held)
            writer = out.write.mode("append").option("compression", self.compression)
            if self.rows:
                writer = writer.option("maxRecordsPerFile", self.rows)
            writer.parquet(self.path)
            self.held = []
        self.since = self.clock()

    def close(self) -> None:
        self.flush()


class BatchingSink:
    """Gathers batches for any sink and hands them on together, once they have
    max_rows rows or the oldest has waited delay_ms. What it holds is lost if the
    driver is: use it where at-most-once will do."""

    def __init__(self, sink: Sink, max_rows: int = 1000, delay_ms: int | None = None, clock=time.monotonic):
        self.sink, self.max_rows, self.delay, self.clock = sink, max_rows, delay_ms, clock
        self.held: list[DataFrame] = []
        self.rows, self.since = 0, None

    def write(self, batch: DataFrame) -> None:
        kept = cut(weighted(batch))
        self.held.append(kept)
        self.rows += kept.count()
        self.since = self.clock() if self.since is None else self.since
        if self.rows >= self.max_rows or (self.delay is not None and (self.clock() - self.since) * 1000 >= self.delay):
            self.flush()

    def flush(self) -> None:
        held, self.held, self.rows, self.since = self.held, [], 0, None
        if held:
            self.sink.write(reduce(lambda a, b: a.unionByName(b), held))

    def close(self) -> None:
        self.flush()
        self.sink.close()


class SchemaCache:
    """A query's result schema beside its output; one of another query is refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def check(self, query: str, schema: StructType) -> StructType:
        key = hashlib.sha256(query.encode()).hexdigest()
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            stream = fs.open(at)
            known = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()
            if known["query"] != key:
                raise ValueError(f"{self.path} has the schema of another query")
            return StructType.fromJson(known["schema"])
        stream = fs.create(at, False)
        stream.write(json.dumps({"query": key, "schema": schema.jsonValue()}).encode())
        stream.close()
        return schema
