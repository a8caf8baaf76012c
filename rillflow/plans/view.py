"""The batch compiler: a plan over tables becomes one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions import zset
from rillflow.functions.zset import WEIGHT, col, columns, weighted
from rillflow.operators import aggregate, join, order, timewindow
from rillflow.plans import nodes as N


def unary(node: N.Node, df: DataFrame) -> DataFrame:
    """An operator with one input, over that input's rows."""
    match node:
        case N.Filter():
            return df.where(F.expr(node.predicate))
        case N.Project():
            return df.select(*[F.expr(e).alias(n) for e, n in node.items], WEIGHT)
        case N.Map():
            return weighted(node.apply(df))
        case N.Distinct():
            return zset.distinct(df)
        case N.GroupAgg():
            return aggregate.aggregate(df, node.keys, node.aggs)
        case N.GroupMap():
            rows = zset.expand(df).drop(WEIGHT)
            return weighted(rows.groupBy(*[col(k) for k in node.keys]).applyInPandas(node.apply, node.schema))
        case N.TimeWindow():
            return timewindow.windowed(df, node.kind, node.time, node.size, node.slide, node.keys, node.aggs)
        case N.Over():
            return order.over(df, node.items)
        case N.GroupsFrame():
            return order.groups_frame(df, node.fn, node.expression, node.partition, node.order, node.start, node.end, node.name)
        case N.Sort():
            return order.sort(df, node.order)
        case N.Limit():
            return order.limit(df, node.count, node.offset)
        case N.TopK():
            return order.top_k(df, node.k, node.order, node.partition, node.offset)
    raise TypeError(f"no operator for {type(node).__name__}")


def binary(node: N.Node, left: DataFrame, right: DataFrame) -> DataFrame:
    match node:
        case N.Join():
            return join.equi_join(left, right, node.on, node.how)
        case N.Union():
            return zset.union(left, right)
        case N.Difference():
            return zset.difference(left, right)
    raise TypeError(f"no operator for {type(node).__name__}")


def scan(node: N.Scan, df: DataFrame) -> DataFrame:
    df = weighted(df)
    if node.alias is None:
        return df
    return df.select(*[col(c).alias(f"{node.alias}.{c}") for c in columns(df)], WEIGHT)


def compile_view(plan: N.Node, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of the plan's result, with __count."""
    if isinstance(plan, N.Scan):
        if plan.name not in tables:
            raise KeyError(f"unknown table {plan.name}")
        return scan(plan, tables[plan.name])
    if isinstance(plan, N.Limit) and isinstance(plan.input, N.Sort):  # rows in between would lose the order
        plan = N.TopK(plan.input.input, plan.count, plan.input.order, offset=plan.offset)
    inputs = [compile_view(i, tables) for i in plan.inputs]
    return unary(plan, *inputs) if len(inputs) == 1 else binary(plan, *inputs)


def view(plan: N.Node, tables: dict[str, DataFrame], keep_weight: bool = False) -> DataFrame:
    """The plan's result as plain rows, each as often as it counts; keep_weight
    leaves them folded, with __count."""
    out = compile_view(plan, tables)
    if keep_weight:
        return out
    if all(WEIGHT not in tables[s].columns for s in plan.sources()) and not _has(plan, N.Difference):
        return out.drop(WEIGHT)  # every count is one
    return zset.expand(out).drop(WEIGHT)


def _has(plan: N.Node, kind: type) -> bool:
    return isinstance(plan, kind) or any(_has(i, kind) for i in plan.inputs)
