"""Results of incremental queries under the fixed names of the delta contract."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame

from rillflow.functions.zset import col
from rillflow.operators.aggregate import contracted
from rillflow.operators.timewindow import END, START
from rillflow.plans import nodes as N


def by_contract(plan: N.Node) -> Callable[[DataFrame], DataFrame]:
    """What gives a tick's output the contract's form: of a grouped query one row of
    changes for each group (see contracted), of a query with one window function
    its rows with the function's value as agg_result. Columns besides those of the
    plan (__late) are kept, as keys. Other plans are refused."""
    given, node = None, plan
    if isinstance(node, N.Project):
        given, node = {e.strip("`"): n for e, n in node.items}, node.input
    below = node.input if isinstance(node, N.Filter) else node
    if isinstance(below, (N.GroupAgg, N.TimeWindow)):
        keys = [n for _, n in below.keys] + ([START, END] if isinstance(below, N.TimeWindow) else [])
        names = {n: n for n in (*keys, *(a.name for a in below.aggs))} if given is None else given
        if set(names) <= {*keys, *(a.name for a in below.aggs)}:
            aggs = tuple(replace(a, name=names[a.name]) for a in below.aggs if a.name in names)
            own = [names[k] for k in keys if k in names]
            known = {*own, *(a.name for a in aggs), "__count"}
            return lambda out: contracted(out, [*own, *(c for c in out.columns if c not in known)], aggs)
    if isinstance(below, N.Over) and len(below.items) == 1:
        name = (given or {}).get(below.items[0][1], below.items[0][1])
        return lambda out: out.select(*[col(c).alias("agg_result") if c == name else col(c) for c in out.columns])
    raise ValueError("the delta contract takes plain aggregates of groups, or one window function")
