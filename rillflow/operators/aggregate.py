"""Grouped aggregates of weighted rows, as views and as deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.zset import WEIGHT, col, consolidate, weighted
from rillflow.plans.nodes import Agg

TOTAL = "__rows"


def linear(aggs: tuple[Agg, ...]) -> bool:
    """Whether a delta alone gives the change of all of them."""
    return all(a.fn in ("sum", "count", "avg") and not a.distinct for a in aggs)


def merged(a: Agg) -> Column:
    """The aggregate of weighted rows. Nulls are ignored; no value gives null, or
    zero for a count."""
    w = F.col(WEIGHT)
    if a.fn == "count" and a.expression.strip() == "*":
        return F.coalesce(F.sum(w), F.lit(0))
    x = F.expr(a.expression)
    if a.distinct:
        return {"count": F.count_distinct, "sum": F.sum_distinct}[a.fn](F.when(w > 0, x))
    count = F.coalesce(F.sum(F.when(x.isNotNull(), w)), F.lit(0))
    if a.fn == "count":
        return count
    if a.fn == "sum":
        return F.when(count != 0, F.sum(x * w))
    if a.fn == "avg":
        return F.when(count != 0, F.sum(x.cast("double") * w) / count)
    return {"min": F.min, "max": F.max}[a.fn](F.when(w > 0, x))


def aggregate(df: DataFrame, keys: tuple[tuple[str, str], ...], aggs: tuple[Agg, ...]) -> DataFrame:
    """One row, with __count 1, for each group that has rows."""
    named = weighted(df)
    grouped = named.groupBy(*[F.expr(e).alias(n) for e, n in keys])
    out = grouped.agg(*[merged(a).alias(a.name) for a in aggs], F.coalesce(F.sum(WEIGHT), F.lit(0)).alias(TOTAL))
    if keys:
        out = out.where(F.col(TOTAL) != 0)
    return out.drop(TOTAL).withColumn(WEIGHT, F.lit(1).cast("long"))


#: fixed names of the delta contract
CONTRACT = {"sum": "agg_delta", "count": "count_delta", "avg": "avg_delta", "min": "min", "max": "max"}


def contract(aggs: tuple[Agg, ...]) -> list[str]:
    """The aggregates' names in the delta contract; a second one of a kind gets its
    own name as a suffix."""
    seen: set[str] = set()
    out = []
    for a in aggs:
        n = CONTRACT[a.fn]
        out.append(f"{n}_{a.name}" if n in seen else n)
        seen.add(n)
    return out


def contracted(change: DataFrame, keys: list[str], aggs: tuple[Agg, ...]) -> DataFrame:
    """The signed change of a grouped result as one row for each group, __count 1:
    what sums, counts and averages change by (no value counts as zero), and the
    extremes as they are now (null for a group that is gone). Groups without a
    change are left out."""
    w, out, changed = F.col(WEIGHT), [], F.lit(False)
    for a, n in zip(aggs, contract(aggs), strict=True):
        if a.fn in ("min", "max"):
            now, before = (F.max(F.when(sign, col(a.name))) for sign in (w > 0, w < 0))
            out += [now.alias(n), before.alias(f"__was_{n}")]
            changed = changed | ~col(n).eqNullSafe(col(f"__was_{n}"))
        else:
            by = F.coalesce(F.sum(col(a.name) * w), F.lit(0)).cast("long" if a.fn == "count" else "double")
            out.append(by.alias(n))
            changed = changed | (col(n) != 0)
    rows = change.groupBy(*[col(k) for k in keys]).agg(*out).where(changed)
    return rows.select(*[col(k) for k in keys], *[col(n) for n in contract(aggs)], F.lit(1).cast("long").alias(WEIGHT))


def partials(df: DataFrame, keys: tuple[tuple[str, str], ...], aggs: tuple[Agg, ...]) -> DataFrame:
    """The state of linear aggregates: for each group the number of rows, and each
    aggregate's sum and number of values. Adding two states gives the state of both."""
    w = F.col(WEIGHT)
    out = [F.sum(w).alias(TOTAL)]
    for i, a in enumerate(aggs):
        x = None if a.expression.strip() == "*" else F.expr(a.expression)
        out.append(F.sum(w if x is None else F.when(x.isNotNull(), w).otherwise(0)).alias(f"__n{i}"))
        if a.fn != "count":
            x = x.cast("double") if a.fn == "avg" else x
            out.append(F.sum(x * w).alias(f"__s{i}"))
    return weighted(df).groupBy(*[F.expr(e).alias(n) for e, n in keys]).agg(*out)


def add_states(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in new.columns if c not in keys]
    return old.unionByName(new).groupBy(*[col(k) for k in keys]).agg(*[F.sum(col(c)).alias(c) for c in values])


def standing(state: DataFrame, keys: list[str]) -> DataFrame:
    """The groups that have rows; the one group without keys always stands."""
    return state.where(F.col(TOTAL) != 0) if keys else state


def latest(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each group's states the last by `order`. A group is stored anew instead of
    being added up, so that its sums of doubles are taken back as they were given."""
    values = [c for c in states.columns if c not in (*keys, order)]
    last = states.groupBy(*[col(k) for k in keys]).agg(F.max_by(F.struct(*[col(c) for c in values]), F.col(order)).alias("__last"))
    return last.select(*[col(k) for k in keys], *[F.col("__last").getField(c).alias(c) for c in values]).where(F.col("__last").isNotNull())


def finished(state: DataFrame, keys: list[str], aggs: tuple[Agg, ...]) -> DataFrame:
    """Result rows of a state."""
    out = []
    for i, a in enumerate(aggs):
        n = F.col(f"__n{i}")
        value = n if a.fn == "count" else F.when(n != 0, F.col(f"__s{i}") / n if a.fn == "avg" else F.col(f"__s{i}"))
        out.append(value.alias(a.name))
    return state.select(*[col(k) for k in keys], *out, F.lit(1).cast("long").alias(WEIGHT))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """-old +new, what is in both left out."""
    return consolidate(old.withColumn(WEIGHT, -F.col(WEIGHT)).unionByName(new))
