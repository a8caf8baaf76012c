"""Watermarks that advance row by row, and policies for late rows.

The watermark at a row is the greatest event time up to and with it, less the
allowed disorder. A row behind the watermark is late, one more than the allowed
lateness behind it is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.zset import WEIGHT, col, consolidate, negate, union, weighted
from rillflow.operators.timewindow import END, START, sessions, windowed
from rillflow.session import cut

CLASS, LATE = "__class", "__late"
POLICIES = ("drop", "buffer", "emit")


@dataclass(frozen=True)
class WatermarkConfig:
    enabled: bool = False
    max_out_of_orderness: int = 0
    allowed_lateness: int = 0
    policy: str = "drop"
    max_buffer_size: int = 1000

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise ValueError(f"policy is one of {', '.join(POLICIES)}")


def classify(df: DataFrame, sequence: str, time: str, disorder: int, lateness: int, carried: int | None = None) -> DataFrame:
    """Rows with __class: ontime, late or dropped, in the order of the sequence
    column. carried is the greatest event time of earlier batches.

    The rows are range-partitioned by sequence, each range's greatest time goes to
    the driver (one number for each), and a running maximum within the range is
    enough: no task sees all rows.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, sequence).withColumn("__range", F.spark_partition_id()))
    t = F.col(time).cast("long")
    tops = {r["__range"]: r["top"] for r in placed.groupBy("__range").agg(F.max(t).alias("top")).collect()}
    before, top = {}, carried
    for part in sorted(tops):
        before[part] = top
        top = tops[part] if top is None else top if tops[part] is None else max(top, tops[part])
    known = {p: b for p, b in before.items() if b is not None}
    earlier = F.element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]), F.col("__range")) if known else F.lit(None)
    earlier = earlier.cast("long")
    running = F.max(t).over(Window.partitionBy("__range").orderBy(sequence).rowsBetween(Window.unboundedPreceding, 0))
    mark = F.greatest(earlier, running) - disorder
    kind = F.when(t < mark - lateness, "dropped").when(t < mark, "late").otherwise("ontime")
    return placed.withColumn(CLASS, F.when(t.isNull(), "dropped").otherwise(kind)).drop("__range")


class WatermarkWindow:
    """A time-window aggregate with a late policy: `drop` ignores late rows, `emit`
    adds them in a second pass whose rows are marked __late, `buffer` keeps them, all
    of them, in a table aside for reprocess_late(); once it holds more than
    max_buffer_size rows, the tick adds them itself. Each tick returns result changes; its state is the rows
    of the windows that may still change. tables() and top are all of it."""

    def __init__(self, node, config: WatermarkConfig, sequence: str = "__seq"):
        self.node, self.config, self.sequence = node, config, sequence
        self.rows: DataFrame | None = None
        self.buffer: DataFrame | None = None
        self.top: int | None = None

    def tables(self) -> dict[str, DataFrame | None]:
        return {"rows": self.rows, "buffer": self.buffer}

    def restore(self, tables: dict[str, DataFrame | None]) -> None:
        self.rows, self.buffer = tables["rows"], tables["buffer"]

    @property
    def watermark(self) -> int:
        return 0 if self.top is None else max(0, self.top - self.config.max_out_of_orderness)

    def _result(self, rows: DataFrame) -> DataFrame:
        n = self.node
        if n.kind == "session":  # a row that is taken back is in no session; it has another number than the one it takes back
            rows = consolidate(rows.drop(self.sequence))
        return windowed(rows, n.kind, n.time, n.size, n.slide, n.keys, n.aggs)

    def _add(self, rows: DataFrame, late: bool) -> DataFrame:
        old = rows.limit(0) if self.rows is None else self.rows
        new = cut(union(old, rows))
        change = consolidate(union(negate(self._result(old)), self._result(new)))
        self.rows = new
        return change.withColumn(LATE, F.lit(late))

    def tick(self, batch: DataFrame) -> DataFrame:
        c = self.config
        found = cut(classify(weighted(batch), self.sequence, self.node.time, c.max_out_of_orderness, c.allowed_lateness, self.top))
        top = found.agg(F.max(F.col(self.node.time).cast("long"))).first()[0]
        self.top = top if self.top is None else self.top if top is None else max(top, self.top)
        out = self._add(found.where(F.col(CLASS) == "ontime").drop(CLASS), False)
        late = found.where(F.col(CLASS) == "late").drop(CLASS)
        if c.policy == "emit":
            out = union(out, self._add(late, True))
        elif c.policy == "buffer":
            held = late if self.buffer is None else union(self.buffer, late)
            self.buffer = cut(held)
            if self.buffer.count() > c.max_buffer_size:
                out = union(out, self.reprocess_late())
        out = cut(out)
        self._collect()
        return out

    def reprocess_late(self) -> DataFrame | None:
        """Adds the buffered late rows and empties the buffer."""
        if self.buffer is None:
            return None
        out = cut(self._add(self.buffer, True))
        self.buffer = None
        return out

    def _collect(self) -> None:
        """Forgets rows all of whose windows ended before anything can reach them. A
        session is beyond reach once it ended more than the allowed lateness behind
        the watermark: a row that is still taken comes after its end."""
        n = self.node
        if self.rows is None:
            return
        limit = self.watermark - self.config.allowed_lateness
        if n.kind == "session":
            number = F.lit(None).cast(self.rows.schema[self.sequence].dataType)
            rows = cut(consolidate(self.rows.drop(self.sequence)).withColumn(self.sequence, number))
            held = rows.withColumn("__waits", F.lit(False))
            if self.buffer is not None:  # a session that a waiting row joins stays
                held = held.unionByName(self.buffer.withColumn("__waits", F.lit(True)))
            placed = sessions(held, n.time, n.size, n.keys)
            one = Window.partitionBy(*[F.expr(e) for e, _ in n.keys], START)
            placed = placed.withColumn("__joined", F.max("__waits").over(one)).where(~F.col("__waits"))
            open_ = placed.where((F.col(END) >= limit) | F.col("__joined")).select(*[col(c) for c in rows.columns])
            self.rows = cut(open_.unionByName(rows.where(F.col(WEIGHT) < 0)))  # what is taken back may come later
            return
        t = F.expr(n.time).cast("long")
        end = t - F.pmod(t, F.lit(n.slide)) + n.size  # of the last window that has the row
        self.rows = cut(self.rows.where(end >= limit))
