"""Event-time windows over milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.zset import WEIGHT, weighted
from rillflow.operators.aggregate import aggregate

START, END = "__window_start", "__window_end"


def floor_to(time: Column, step: int) -> Column:
    return time - F.pmod(time, F.lit(step))


def assign(df: DataFrame, kind: str, time: str, size: int, slide: int) -> DataFrame:
    """Rows with the windows that they fall in; rows without a time are left out.
    Hopping windows begin at multiples of slide, none before zero."""
    t = F.expr(time).cast("long")
    df = weighted(df).where(t.isNotNull())
    if kind == "tumble":
        df = df.withColumn(START, floor_to(t, size))
    else:
        first = F.greatest(floor_to(t - size, slide) + slide, F.lit(0).cast("long"))
        df = df.withColumn(START, F.explode(F.when(first <= floor_to(t, slide), F.sequence(first, floor_to(t, slide), F.lit(slide).cast("long")))))
    return df.withColumn(END, F.col(START) + size)


def sessions(df: DataFrame, time: str, gap: int, keys: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows with the session they are in: one ends where the next row of its key is
    more than gap later, and lasts gap beyond its last row."""
    t = F.expr(time).cast("long")
    df = weighted(df).where(t.isNotNull() & (F.col(WEIGHT) > 0)).withColumn("__t", t)
    by = Window.partitionBy(*[F.expr(e) for e, _ in keys])
    ordered = by.orderBy("__t")
    new = F.coalesce((F.col("__t") - F.lag("__t").over(ordered) > gap).cast("int"), F.lit(1))
    df = df.withColumn("__new", new)
    df = df.withColumn("__session", F.sum("__new").over(ordered.rangeBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy(*[F.expr(e) for e, _ in keys], "__session")
    df = df.withColumn(START, F.min("__t").over(one)).withColumn(END, F.max("__t").over(one) + gap)
    return df.drop("__t", "__new", "__session")


def windowed(df: DataFrame, kind: str, time: str, size: int, slide: int, keys, aggs) -> DataFrame:
    placed = sessions(df, time, size, keys) if kind == "session" else assign(df, kind, time, size, slide)
    return aggregate(placed, (*keys, (START, START), (END, END)), aggs)
