"""The incremental compiler: what a plan's result changes by, given what its tables
change by.

    filter, project, map, union, difference   the operator itself, over the delta
    inner join                                dL x R + L x dR + dL x dR
    sum, count, avg                           state of partial sums, touched groups only
    all others                                the touched partitions, before and after

An outer, semi or anti join is recomputed for the touched keys. A plan node's
state is kept under the node's place in the plan; a tick reads and checks the
rows of touched keys only, and appends its delta.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

from rillflow.functions.zset import WEIGHT, check, col, columns, consolidate, integrate, union, weighted
from rillflow.operators import aggregate as A
from rillflow.operators import join as J
from rillflow.operators import timewindow as W
from rillflow.plans import nodes as N
from rillflow.plans import view as V
from rillflow.streaming.state import RUN, StateStore


def _touched(df: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df with a key that the delta has; null is a key like others."""
    if not keys:
        return df
    k = delta.select(*[col(c).alias(f"__k_{c}") for c in keys]).distinct()
    cond = None
    for c in keys:
        one = df[f"`{c}`"].eqNullSafe(k[f"`__k_{c}`"])
        cond = one if cond is None else cond & one
    return df.join(k, cond, "left_semi")


def _recompute(node: N.Node, old: DataFrame, new: DataFrame) -> DataFrame:
    return A.changes(weighted(V.unary(node, old)), weighted(V.unary(node, new)))


def _bag(rows: DataFrame, _: bool = True) -> DataFrame:
    return consolidate(rows.drop(RUN))


def _common(left: DataFrame, right: DataFrame, on) -> list[str | None] | None:
    """What each pair of join keys is cast to before it is hashed, so that equal
    keys have equal hashes; None if there may be equal keys that have not."""
    out = []
    for l, r in on:
        a, b = left.schema[l].dataType, right.schema[r].dataType
        if a == b:
            out.append(None)
        elif isinstance(a, IntegralType) and isinstance(b, IntegralType):
            out.append("bigint")
        else:
            return None
    return out


class Delta:
    """One tick over a plan. Reads the state of the version before, stages that of
    the version after; the caller commits."""

    def __init__(self, store: StateStore, deltas: dict[str, DataFrame], schemas: dict[str, DataFrame]):
        self.store, self.deltas, self.schemas = store, deltas, schemas

    def of(self, node: N.Node, at: str = "0") -> DataFrame:
        if isinstance(node, N.Scan):
            d = self.deltas.get(node.name)
            return V.scan(node, self.schemas[node.name].limit(0) if d is None else d)
        inputs = [self.of(i, f"{at}.{n}") for n, i in enumerate(node.inputs)]
        match node:
            case N.Filter() | N.Project() | N.Map():
                return V.unary(node, *inputs)
            case N.Union():
                return V.binary(node, *inputs)
            case N.Difference():
                return V.binary(node, *inputs)
            case N.Join():
                return self.join(node, at, *[self.store.hold(f"{at}.d{n}", consolidate(i)) for n, i in enumerate(inputs)])
            case N.GroupAgg() if A.linear(node.aggs):
                return self.linear(node.keys, node.aggs, at, inputs[0])
            case N.TimeWindow() if node.kind != "session" and A.linear(node.aggs):
                placed = W.assign(inputs[0], node.kind, node.time, node.size, node.slide)
                return self.linear((*node.keys, (W.START, W.START), (W.END, W.END)), node.aggs, at, placed)
            case N.Sort():
                return inputs[0]  # a delta has no order; the view sorts
        return self.keyed(node, at, self.store.hold(f"{at}.d", consolidate(inputs[0])))

    def state(self, at: str, delta: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """(before, after) of those rows of an input that have a key of the delta's;
        the delta is added to what is kept."""
        key = [(c, None) for c in keys]
        old = self.store.near(at, delta, key)
        old = delta.limit(0) if old is None else self.store.hold(f"{at}.o", _bag(_touched(old, delta, keys)))
        new = integrate(old, delta)
        if self.lowers(delta):
            check(new, f"state {at}")
        self.store.append(at, delta, key, _bag)
        return old, new

    @staticmethod
    def lowers(delta: DataFrame) -> bool:
        """Whether it takes anything away; else no count can fall below zero."""
        return bool(delta.where(F.col(WEIGHT) < 0).limit(1).collect())

    def join(self, node: N.Join, at: str, left: DataFrame, right: DataFrame) -> DataFrame:
        casts = _common(left, right, node.on)
        names = [f"__j{i}" for i in range(len(node.on))]
        own = [[(p[i], t) for p, t in zip(node.on, casts or [None] * len(node.on), strict=True)] for i in (0, 1)]

        def kept(i: int, keys: DataFrame, key) -> DataFrame:
            """The rows kept of a side that may have one of the keys."""
            got = self.store.whole(f"{at}.{'lr'[i]}") if casts is None else self.store.near(f"{at}.{'lr'[i]}", keys, key)
            return (left, right)[i].limit(0) if got is None else got.drop(RUN)

        for i, delta in enumerate((left, right)):
            if self.lowers(delta):
                same = self.store.near(f"{at}.{'lr'[i]}", delta, own[i])
                same = delta.limit(0) if same is None else _touched(same.drop(RUN), delta, columns(delta))
                check(integrate(same, delta), f"state {at}.{'lr'[i]}")
            self.store.append(f"{at}.{'lr'[i]}", delta, own[i], _bag)
        if node.how == "inner":
            return J.delta_join(left, kept(0, right, own[1]), right, kept(1, left, own[0]), node.on)
        pick = lambda df, i: df.select(*[col(p[i]).alias(k) for p, k in zip(node.on, names, strict=True)])
        touched = pick(left, 0).union(pick(right, 1))
        old, new = [], []
        for i, delta in enumerate((left, right)):
            before = kept(i, touched, [(n, t) for n, t in zip(names, casts or [], strict=False)])
            of_keys = lambda df: _touched(df.withColumns({k: col(p[i]) for p, k in zip(node.on, names, strict=True)}), touched, names).drop(*names)  # noqa: B023, E731
            old.append(self.store.hold(f"{at}.o{i}", consolidate(of_keys(before))))
            new.append(integrate(old[i], of_keys(delta)))
        return consolidate(union(V.binary(node, *old).withColumn(WEIGHT, -F.col(WEIGHT)), V.binary(node, *new)))

    def linear(self, keys, aggs, at: str, delta: DataFrame) -> DataFrame:
        """Groups of the delta only; a group without rows is forgotten, one whose
        rows went below none is an error."""
        names = [n for _, n in keys]
        key = [(n, None) for n in names]
        part = self.store.hold(f"{at}.p", A.partials(delta, keys, aggs))
        old = self.store.near(at, part, key)
        old = part.limit(0) if old is None else self.store.hold(f"{at}.o", A.latest(_touched(old, part, names), names, RUN))
        new = self.store.hold(f"{at}.n", A.add_states(old, part, names))
        check(new.withColumnRenamed(A.TOTAL, WEIGHT), f"group of {at}")

        def merge(states: DataFrame, whole: bool) -> DataFrame:
            last = A.latest(states, names, RUN)
            return A.standing(last, names) if whole else last

        self.store.append(at, new, key, merge)
        return A.changes(*[A.finished(A.standing(s, names), names, aggs) for s in (old, new)])

    def keyed(self, node: N.Node, at: str, delta: DataFrame) -> DataFrame:
        """Recomputes the partitions that the delta touches."""
        match node:
            case N.GroupAgg() | N.TimeWindow():
                keys = node.keys
                if isinstance(node, N.TimeWindow) and node.kind != "session":
                    delta = W.assign(delta, node.kind, node.time, node.size, node.slide)
                    keys = (*keys, (W.START, W.START), (W.END, W.END))
                    node = N.GroupAgg(node.input, keys, node.aggs)
                delta = delta.withColumns({f"__g{i}": F.expr(e) for i, (e, _) in enumerate(keys)})
                node = replace(node, keys=tuple((f"__g{i}", n) for i, (_, n) in enumerate(keys)))
                partition = [f"__g{i}" for i in range(len(keys))]
            case N.Over() | N.GroupsFrame() | N.TopK():
                partition = list(node.partition)
            case N.GroupMap():
                partition = list(node.keys)
            case N.Distinct():
                partition = columns(delta)
            case N.Limit():
                partition = []
            case _:
                raise TypeError(f"no delta rule for {type(node).__name__}")
        old, new = self.state(at, delta, partition)
        if isinstance(node, (N.GroupAgg, N.TimeWindow, N.Over, N.GroupsFrame)):
            after = weighted(V.unary(node, new))
            if any(isinstance(f.dataType, (FloatType, DoubleType)) for f in after.schema):
                names = [n for _, n in node.keys] if isinstance(node, (N.GroupAgg, N.TimeWindow)) else partition
                return self.given(f"{at}.y", delta.select(*[col(p).alias(n) for p, n in zip(partition, names, strict=True)]), after)
        return _recompute(node, old, new)

    def given(self, at: str, touched: DataFrame, after: DataFrame) -> DataFrame:
        """The change to `after` from what was given out before for the touched keys.
        Results with floating sums are kept for this: computed anew, they can differ
        in the last bit, as sums do with the order of the rows, and would not be
        taken back as they were given."""
        key = [(n, None) for n in touched.columns]
        old = self.store.near(at, touched, key)
        old = after.limit(0) if old is None else _touched(old.drop(RUN), touched, touched.columns)
        change = self.store.hold(f"{at}.c", A.changes(old, after))
        self.store.append(at, change, key, _bag)
        return change
