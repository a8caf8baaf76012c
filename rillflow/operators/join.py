"""Equi-joins of weighted tables: whole, by delta rules, and with expiring state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.zset import WEIGHT, check, col, columns, consolidate, negate, union, weighted
from rillflow.session import cut


def equi_join(left: DataFrame, right: DataFrame, on: tuple[tuple[str, str], ...], how: str = "inner") -> DataFrame:
    """Weights multiply; null keys match nothing. Of a column that both have, the
    right one's is named right_<column>, unless it is a key of the same name."""
    left, right = weighted(left), weighted(right)
    names = {c: c if c not in columns(left) else f"right_{c}" for c in columns(right)}
    same = {r for l, r in on if l == r}
    r = right.select(*[col(c).alias(f"__r_{c}") for c in columns(right)], F.col(WEIGHT).alias("__rw"))
    cond = None
    for a, b in on:
        one = left[f"`{a}`"] == r[f"`__r_{b}`"]
        cond = one if cond is None else cond & one
    joined = left.join(r, cond, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    if how in ("semi", "anti"):
        return joined.select(*[col(c) for c in columns(left)], WEIGHT)
    out = [F.coalesce(col(c), col(f"__r_{c}")).alias(c) if c in same and how in ("right", "full") else col(c) for c in columns(left)]
    out += [col(f"__r_{c}").alias(n) for c, n in names.items() if c not in same]
    w = F.coalesce(F.col(WEIGHT), F.lit(1)) * F.coalesce(F.col("__rw"), F.lit(1))
    return joined.select(*out, w.alias(WEIGHT))


def delta_join(left_delta: DataFrame, left_old: DataFrame, right_delta: DataFrame, right_old: DataFrame, on) -> DataFrame:
    """The change of an inner join: dL x R + L x dR + dL x dR. No side is hinted:
    at run time the planner broadcasts a delta that is small enough."""
    return consolidate(union(equi_join(left_delta, right_old, on), equi_join(left_old, right_delta, on), equi_join(left_delta, right_delta, on)))


class ExpiringJoin:
    """An inner join whose state forgets rows that were not inserted for ttl
    milliseconds of processing time, and takes their results back.

    A pair is taken back once: left rows go first, against the right state before
    its own rows go. now is given with each tick, so that a replay gives the same.
    tables() is all of its state.
    """

    def __init__(self, on: tuple[tuple[str, str], ...], ttl: int):
        self.on, self.ttl = on, ttl
        self.left: DataFrame | None = None
        self.right: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame | None]:
        return {"left": self.left, "right": self.right}

    def restore(self, tables: dict[str, DataFrame | None]) -> None:
        self.left, self.right = tables["left"], tables["right"]

    def _merge(self, state: DataFrame, delta: DataFrame, now: int) -> DataFrame:
        """State after a delta; an insert renews the row's expiry."""
        until = F.when(F.col(WEIGHT) > 0, F.lit(now + self.ttl)).otherwise(F.lit(0)).cast("long")
        names = columns(delta)
        both = state.unionByName(delta.withColumn("__until", until))
        merged = both.groupBy(*[col(c) for c in names]).agg(F.sum(WEIGHT).alias(WEIGHT), F.max("__until").alias("__until"))
        merged = cut(merged.where(F.col(WEIGHT) != 0))
        check(merged, "join state")
        return merged

    def tick(self, left_delta: DataFrame, right_delta: DataFrame, now: int) -> DataFrame:
        left_delta, right_delta = consolidate(left_delta), consolidate(right_delta)
        empty = lambda d: d.limit(0).withColumn("__until", F.lit(0).cast("long"))
        left = empty(left_delta) if self.left is None else self.left
        right = empty(right_delta) if self.right is None else self.right
        gone_l, stay_l = left.where(F.col("__until") <= now), left.where(F.col("__until") > now)
        gone_r, stay_r = right.where(F.col("__until") <= now), right.where(F.col("__until") > now)
        bare = lambda s: s.drop("__until")
        lost = negate(union(equi_join(bare(gone_l), bare(right), self.on), equi_join(bare(stay_l), bare(gone_r), self.on)))
        new = union(equi_join(left_delta, bare(stay_r), self.on), equi_join(bare(stay_l), right_delta, self.on), equi_join(left_delta, right_delta, self.on))
        out = cut(consolidate(union(lost, new)))
        self.left, self.right = self._merge(stay_l, left_delta, now), self._merge(stay_r, right_delta, now)
        return out
