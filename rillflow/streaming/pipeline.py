"""Configured pipelines: source, query, sink.

    source:    {type: csv|parquet|json_dir|http|chain, config: {...}}
    transform: {type: sql, query: ..., join_ttl: 10s, watermark: {...}, names: alias|contract}
    sink:      {type: console|json|csv|parquet, config: {...}, batch: {...}}
    state:     {path: ...}

With names: contract, a sink gets one row of changes for each group, under fixed
names (agg_delta, count_delta, avg_delta, min, max, agg_result).
A source may name the table that it feeds (table, else the query's only one);
`sources` takes several, so that joins run too.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow import sinks
from rillflow.functions.intervals import duration_ms, interval_ms
from rillflow.functions.zset import weighted
from rillflow.plans import nodes as N
from rillflow.plans.contract import by_contract
from rillflow.plans.sql import plan as parse
from rillflow.plans.view import scan, unary
from rillflow.sources import ChainSource, CsvSource, ParquetSource, StreamSource, schema_of
from rillflow.streaming.engine import IncrementalQuery
from rillflow.streaming.state import StateStore
from rillflow.streaming.watermark import LATE, WatermarkConfig, WatermarkWindow

TOP = "@top"  # in a position: the greatest event time so far


def milliseconds(value) -> int | None:
    if value is None or isinstance(value, int):
        return value
    try:
        return duration_ms(value)
    except ValueError:
        return interval_ms(value)


@dataclass(frozen=True)
class Config:
    sources: dict[str, dict]
    query: str
    sink: dict
    state: str
    join_ttl: int | None = None
    watermark: WatermarkConfig = field(default_factory=WatermarkConfig)
    names: str = "alias"

    @classmethod
    def load(cls, raw: dict) -> Config:
        t = raw.get("transform") or {}
        if t.get("type", "sql") != "sql" or not t.get("query"):
            raise ValueError("transform needs type sql and a query")
        if t.get("names", "alias") not in ("alias", "contract"):
            raise ValueError("names is alias or contract")
        if "sink" not in raw:
            raise ValueError("a sink is missing")
        if "sources" in raw:
            sources = raw["sources"]
        elif "source" in raw:
            sources = {raw["source"].get("table", ""): raw["source"]}
        else:
            raise ValueError("a source is missing")
        w = t.get("watermark") or {}
        mark = WatermarkConfig(w.get("enabled", False), milliseconds(w.get("max_out_of_orderness", 0)), milliseconds(w.get("allowed_lateness", 0)), w.get("policy", "drop"), w.get("max_buffer_size", 1000))
        return cls(sources, t["query"], raw["sink"], (raw.get("state") or {}).get("path", ""), milliseconds(t.get("join_ttl")), mark, t.get("names", "alias"))

    @classmethod
    def read(cls, path: str) -> Config:
        import yaml

        with open(path) as f:
            return cls.load(yaml.safe_load(f))


def source_of(spark: SparkSession, c: dict, log: str | None = None):
    """log: the folder for rows that an http source has taken."""
    k = c.get("config") or {}
    hints = k.get("schema") or {}
    match c.get("type"):
        case "csv":
            return CsvSource(spark, k["path"], hints)
        case "parquet":
            return ParquetSource(spark, k["path"])
        case "json_dir":
            return StreamSource(spark, k["path"], schema_of(hints), "json", k.get("files", 100), k.get("interval"))
        case "http":
            from rillflow.sources.http import HttpSource, IngestLog

            return HttpSource(spark, hints, k.get("port", 8080), k.get("path", "/ingest"), k.get("buffer_size", 1000), k.get("max_batch_size", 100), milliseconds(k.get("max_batch_delay", 0)) or 0, log=IngestLog(spark, log) if log else None)
        case "chain":
            parts = k.get("sources") or []
            if any(p.get("type") not in ("csv", "http", "parquet") for p in parts):
                raise ValueError("a chain holds csv, parquet and http sources")
            return ChainSource([source_of(spark, p, f"{log}/{i}" if log else None) for i, p in enumerate(parts)], k.get("on_error", "stop"))
    raise ValueError(f"unknown source {c.get('type')!r}")


def sink_of(c: dict, spark: SparkSession | None = None, query: str = "") -> sinks.Sink:
    k = c.get("config") or {}
    cache = k.get("schema_cache")
    known = (lambda schema: sinks.SchemaCache(spark, cache).check(query, schema)) if cache and spark else None
    match c.get("type"):
        case "console":
            out = sinks.ConsoleSink(k.get("format", "json"))
        case "json":
            out = sinks.JsonSink(k["path"])
        case "csv":
            out = sinks.CsvSink(k["path"])
        case "parquet":
            out = sinks.ParquetSink(k["path"], k.get("compression", "zstd"), k.get("rotate_batches", 1), milliseconds(k.get("rotate_interval")), rows_per_file=k.get("rows_per_file"), cache=known)
        case "file":
            out = sinks.CsvSink(k["path"]) if k.get("format") == "csv" else sinks.JsonSink(k["path"])
        case other:
            raise ValueError(f"unknown sink {other!r}")
    b = c.get("batch")
    return sinks.BatchingSink(out, b.get("max_batch_size", 1000), milliseconds(b.get("max_batch_delay"))) if b else out


class Pipeline:
    """Runs a configuration. Ticks are numbered, their state is versioned and their
    output kept with it, and so is which files they have read:
    after a stop, the next run writes the last output again if the sink may have missed
    it, skips what was read, and goes on. A batch that a csv or parquet source has given
    is not read again, also by a second run of the same configuration; files that keep
    coming are for json_dir. An http source keeps the rows that it takes with the state
    until a tick has read them. With a watermark or join_ttl, the rows that these still
    need are written at each tick; without a state path, all that lives as long as
    the run."""

    def __init__(self, spark: SparkSession, config: Config, sink: sinks.Sink | None = None):
        self.spark, self.config = spark, config
        self.sources = {}
        for name, c in config.sources.items():
            self.sources[name] = source_of(spark, c, f"{config.state}/ingest/{name or 'only'}" if config.state else None)
        schemas = {n: s.schema for n, s in self.sources.items()}
        names = {n: [f.name for f in s.fields] for n, s in schemas.items()}
        self.plan = parse(config.query, names)
        if "" in self.sources:
            only = self.plan.sources()[0]
            self.sources[only] = self.sources.pop("")
            schemas[only] = schemas.pop("")
        self.sink = sink or sink_of(config.sink, spark, config.query)
        self.form = by_contract(self.plan) if config.names == "contract" else lambda out: out
        self.stopped = False
        self.marked = self._marked() if config.watermark.enabled else None
        self.ttl = self._ttl() if config.join_ttl else None
        self.kept = (self.marked or self.ttl or (None, None, None))[2]
        if not self.kept:
            if not config.state:
                raise ValueError("state needs a path")
            self.query = IncrementalQuery(spark, self.plan, schemas, config.state)
            self.store = self.query.store
        else:
            self.store = StateStore(spark, config.state, f"{type(self.kept).__name__} {self.plan.key()}") if config.state else None
            if self.store:
                self.kept.restore({k: self.store.get(k) for k in self.kept.tables()})
                if self.marked:
                    self.kept.top = self.store.position.get(TOP)

    def _marked(self):
        """(operators above the window, the window with its policy)."""
        above, node = [], self.plan
        while not isinstance(node, N.TimeWindow):
            if len(node.inputs) != 1 or not isinstance(node, (N.Filter, N.Project, N.Map, N.Sort)):
                raise ValueError("a watermark takes filters and projections over a time window")
            above.append(node)
            node = node.inputs[0]
        if node.input.sources() != list(self.sources) or not all(len(n.inputs) < 2 for n in _chain(node.input)):
            raise ValueError("a watermark takes a window over one table")
        return above, node, WatermarkWindow(node, self.config.watermark)

    def _ttl(self):
        from rillflow.operators.join import ExpiringJoin

        above, node = [], self.plan
        while not isinstance(node, N.Join):
            if len(node.inputs) != 1 or not isinstance(node, (N.Filter, N.Project, N.Map)):
                raise ValueError("join_ttl takes filters and projections over a join")
            above.append(node)
            node = node.inputs[0]
        return above, node, ExpiringJoin(node.on, self.config.join_ttl)

    def _send(self, out: DataFrame, number: int) -> None:
        self.sink.write(self.form(out))
        if self.store:
            self.store.mark_sent(number)

    def _tick(self, name: str, batch: DataFrame, number: int, read: dict[str, int] | None = None) -> DataFrame:
        if not self.kept:
            return self.query.tick({name: batch}, number, read)
        if self.store and number == self.store.version:
            return self.store.last_output()
        return self._keep(lambda: self._change(name, batch), number, read)

    def _keep(self, change: Callable[[], DataFrame], number: int, read: dict[str, int] | None = None) -> DataFrame:
        """change(), and with it what a watermark or an expiring join has to know later."""
        if not self.store:
            return change()
        self.store.begin()
        out = self.store.output(change())
        self.kept.restore({k: self.store.put(k, t) for k, t in self.kept.tables().items()})
        top = {TOP: self.kept.top} if self.marked and self.kept.top is not None else {}
        self.store.commit(number, (read or self.store.position) | top)
        return out

    def _above(self, above: list[N.Node], out: DataFrame) -> DataFrame:
        for n in reversed(above):
            if isinstance(n, N.Project) and LATE in out.columns:
                n = N.Project(n.input, (*n.items, (LATE, LATE)))
            out = out if isinstance(n, N.Sort) else unary(n, out)
        return out

    def _change(self, name: str, batch: DataFrame) -> DataFrame:
        if self.marked:
            above, window, state = self.marked
            if "__seq" not in batch.columns:
                batch = batch.withColumn("__seq", F.monotonically_increasing_id())
            for n in reversed(_chain(window.input)):
                batch = unary(n, batch) if not isinstance(n, N.Scan) else weighted(batch)
            return self._above(above, state.tick(batch))
        above, join, state = self.ttl
        sides = [scan(s, batch if s.name == name else batch.sparkSession.createDataFrame([], self.sources[s.name].schema)) for s in (join.left, join.right)]
        return self._above(above, state.tick(*sides, now=int(time.time() * 1000)))

    def batches(self, read: dict[str, int] | None = None) -> Iterator[tuple[str, DataFrame, dict[str, int]]]:
        """(table, batch, what has been read with it), without what read has."""
        read = dict(read or {})
        for name, s in self.sources.items():
            mine = {k.partition(" ")[2]: v for k, v in read.items() if k.startswith(f"{name} ")}
            for b in s.batches(mine):
                if self.stopped:
                    return
                if getattr(s, "origin", None):
                    read[f"{name} {s.origin}"] = getattr(s, "upto", 1)
                yield name, b, dict(read)

    def run(self, once: bool = True) -> int:
        """Runs until the sources are exhausted or stop() is called; returns the
        number of ticks."""
        ticks = 0
        try:
            streams = {n: s for n, s in self.sources.items() if isinstance(s, StreamSource)}
            if streams:
                if len(streams) < len(self.sources) or len(streams) > 1 or self.ttl or not self.store:
                    raise ValueError("a json_dir source is a pipeline's only one, with a state path and without join_ttl")
                (name, source), = streams.items()

                def each(batch: DataFrame, n: int) -> None:
                    nonlocal ticks
                    ticks += 1
                    self._send(self._tick(name, batch, n), n)

                self.running = source.run(each, f"{self.config.state}/stream", once)
                self.running.awaitTermination()
                return ticks
            store = self.store
            if store and store.version > store.sent:
                self._send(store.last_output(), store.version)
            for n, (name, batch, read) in enumerate(self.batches(store.position if store else None), store.version + 1 if store else 0):
                self._send(self._tick(name, batch, n, read), n)
                ticks += 1
            if self.marked and self.kept.buffer is not None:
                n = store.version + 1 if store else ticks
                self._send(self._keep(lambda: self._above(self.marked[0], self.kept.reprocess_late()), n), n)
            return ticks
        finally:
            self.sink.close()
            for s in self.sources.values():
                s.close()

    def stop(self) -> None:
        self.stopped = True
        for s in self.sources.values():
            s.close()
        if getattr(self, "running", None):
            self.running.stop()


def _chain(node: N.Node) -> list[N.Node]:
    out = [node]
    while len(out[-1].inputs) == 1:
        out.append(out[-1].inputs[0])
    return out
