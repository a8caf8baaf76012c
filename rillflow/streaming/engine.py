"""The library's API: prepared incremental queries, and tables changed by DML."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rillflow.functions.zset import WEIGHT, columns, consolidate, weighted
from rillflow.plans import nodes as N
from rillflow.plans.delta import Delta
from rillflow.plans.sql import plan as parse
from rillflow.plans.view import view
from rillflow.streaming import dml
from rillflow.streaming.state import RUN, StateStore


class IncrementalQuery:
    """A plan whose result is kept up to date.

    tick() takes what the tables change by, as weighted rows, and returns what the
    result changes by. Ticks are numbered; giving the number of the last one again
    returns its output without running it. An output can be read until two more
    ticks have been committed; whoever needs it longer writes it elsewhere.
    """

    def __init__(self, spark: SparkSession, query: str | N.Node, schemas: dict[str, StructType], path: str):
        names = {k: [f.name for f in s.fields if f.name != WEIGHT] for k, s in schemas.items()}
        self.plan = query if isinstance(query, N.Node) else parse(query, names)
        self.spark = spark
        self.empty = {k: weighted(spark.createDataFrame([], s)) for k, s in schemas.items()}
        self.store = StateStore(spark, path, self.plan.key())

    @property
    def sources(self) -> list[str]:
        return self.plan.sources()

    def tick(self, deltas: dict[str, DataFrame], number: int | None = None, position: dict[str, int] | None = None) -> DataFrame:
        store = self.store
        number = store.version + 1 if number is None else number
        if number == store.version:
            return store.last_output()
        if number < store.version:
            raise ValueError(f"tick {number} is before the last, {store.version}")
        mine = {k: consolidate(d) for k, d in deltas.items() if k in self.sources}
        store.begin()
        out = store.output(consolidate(Delta(store, mine, self.empty).of(self.plan)))
        store.commit(number, position)
        return out


class Engine:
    """Tables and the queries over them. A change of a table reaches the queries
    that read it, and no others."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        from rillflow.session import cut

        self.spark = spark
        cut(spark.range(1))  # names the shared folder, if there is none yet
        self.path = path or os.path.join(spark.sparkContext.getCheckpointDir(), f"engine-{uuid.uuid4().hex}")
        self.tables: dict[str, StateStore] = {}
        self.schemas: dict[str, StructType] = {}
        self.queries: list[IncrementalQuery] = []

    def create(self, name: str, schema: str | StructType) -> None:
        empty = self.spark.createDataFrame([], schema)
        self.schemas[name] = empty.schema
        self.tables[name] = StateStore(self.spark, f"{self.path}/table-{name}", f"table {name}")

    def table(self, name: str) -> DataFrame:
        """The weighted rows of a table."""
        found = self.tables[name].whole("rows")
        return weighted(self.spark.createDataFrame([], self.schemas[name])) if found is None else consolidate(found.drop(RUN))

    def prepare(self, query: str | N.Node) -> IncrementalQuery:
        """A query that has seen the tables' rows so far."""
        q = IncrementalQuery(self.spark, query, self.schemas, f"{self.path}/query-{len(self.queries)}")
        if any(self.tables[s].version >= 0 for s in q.sources):
            q.tick({s: self.table(s) for s in q.sources})
        self.queries.append(q)
        return q

    def apply(self, name: str, delta: DataFrame) -> dict[IncrementalQuery, DataFrame]:
        """Changes a table by weighted rows, once; returns each reading query's delta."""
        store = self.tables[name]
        store.begin()
        change = store.hold("delta", consolidate(delta))
        Delta(store, {}, {}).state("rows", change, columns(change))
        change = store.output(change)
        store.commit(store.version + 1)
        return {q: q.tick({name: change}) for q in self.queries if name in q.sources}

    def apply_dml(self, statement: str, query: IncrementalQuery | None = None):
        """Runs INSERT, UPDATE or DELETE on the table that it names. Returns the
        deltas of all queries that read it, or of one query (None if it does not)."""
        s = dml.parse(statement)
        out = self.apply(s.table, dml.delta(self.spark, s, self.table(s.table)))
        return out.get(query) if query is not None else out

    def script(self, text: str) -> None:
        for s in dml.statements(text):
            self.apply_dml(s)

    def view(self, query: str | N.Node) -> DataFrame:
        """The result over the tables as they are now."""
        p = query if isinstance(query, N.Node) else parse(query, {k: s.names for k, s in self.schemas.items()})
        return view(p, {s: self.table(s) for s in p.sources()})
