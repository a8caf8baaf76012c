"""Weighted rows: a table whose column __count says how often each row counts.

A delta may hold negative counts; a snapshot must not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHT = "__count"


class Underflow(ValueError):
    """More copies of a row were taken away than there are."""


def weighted(df: DataFrame) -> DataFrame:
    """df with __count, one for each row where there was none."""
    return df if WEIGHT in df.columns else df.withColumn(WEIGHT, F.lit(1).cast("long"))


def columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != WEIGHT]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def consolidate(df: DataFrame) -> DataFrame:
    """One line for each distinct row, with the sum of its counts, zeros left out.
    Columns that cannot be grouped by (maps) are not supported."""
    names = columns(df)
    summed = weighted(df).groupBy(*[col(c) for c in names]).agg(F.sum(WEIGHT).alias(WEIGHT))
    return summed.where(F.col(WEIGHT) != 0).select(*[col(c) for c in names], WEIGHT)


def negate(df: DataFrame) -> DataFrame:
    return weighted(df).withColumn(WEIGHT, -F.col(WEIGHT))


def union(*parts: DataFrame) -> DataFrame:
    """Bag addition."""
    return reduce(lambda a, b: a.unionByName(b), [weighted(p) for p in parts])


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bag subtraction; counts may become negative."""
    return consolidate(union(left, negate(right)))


def distinct(df: DataFrame) -> DataFrame:
    return consolidate(df).where(F.col(WEIGHT) > 0).withColumn(WEIGHT, F.lit(1).cast("long"))


def integrate(snapshot: DataFrame | None, delta: DataFrame) -> DataFrame:
    """The snapshot after the delta. Order within a delta does not matter."""
    return consolidate(delta if snapshot is None else union(snapshot, delta))


def expand(df: DataFrame) -> DataFrame:
    """Each row as often as it counts, with __count 1."""
    w = weighted(df).where(F.col(WEIGHT) > 0)
    return w.withColumn(WEIGHT, F.explode(F.sequence(F.lit(1).cast("long"), F.col(WEIGHT)))).withColumn(WEIGHT, F.lit(1).cast("long"))


def check(df: DataFrame, what: str = "snapshot") -> DataFrame:
    """Raises Underflow if a row of a consolidated table counts less than zero."""
    bad = df.where(F.col(WEIGHT) < 0).limit(1).collect()
    if bad:
        raise Underflow(f"{what}: a row is taken away more often than it is there: {bad[0].asDict()}")
    return df
