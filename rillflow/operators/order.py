"""Sorting, limits, top-k, window functions and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.zset import WEIGHT, columns, expand, quoted, weighted


def _list(items) -> str:
    return ", ".join(items)


def sort(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Nulls first ascending and last descending, as in the engine."""
    names = []
    for o in order:
        parts = o.split()
        c = F.expr(parts[0])
        rest = " ".join(parts[1:]).upper()
        down, nulls = rest.startswith("DESC"), rest.rpartition("NULLS ")[2] if "NULLS" in rest else ""
        nulls = nulls or ("LAST" if down else "FIRST")
        names.append({(False, "FIRST"): c.asc_nulls_first, (False, "LAST"): c.asc_nulls_last, (True, "FIRST"): c.desc_nulls_first, (True, "LAST"): c.desc_nulls_last}[down, nulls]())
    return df.orderBy(*names)


def limit(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    """Counts copies of rows; a negative count is no limit."""
    out = expand(df) if WEIGHT in df.columns else df
    out = out.offset(offset) if offset else out
    return out.limit(count) if count >= 0 else out


def top_k(df: DataFrame, k: int, order: tuple[str, ...], partition: tuple[str, ...] = (), offset: int = 0) -> DataFrame:
    """Without a partition this is one bounded take from each task; with one, the
    engine keeps at most k rows of each partition before the shuffle. The limit and
    offset stand right over the sort: a shuffle between them keeps no order. A
    negative k without a partition is no limit."""
    if not partition and k < 0:
        rows = expand(df)
        return sort(rows.exceptAll(sort(rows, order).limit(offset)) if offset else rows, order)
    if not partition:
        rows = sort(expand(df), order)
        return (rows.offset(offset) if offset else rows).limit(k)
    over = f"row_number() over (partition by {_list(map(quoted, partition))} order by {_list(order)})"
    return expand(df).withColumn("__rank", F.expr(over)).where(F.col("__rank") <= k).drop("__rank")


def over(df: DataFrame, items: tuple[tuple[str, str], ...]) -> DataFrame:
    """Window expressions over rows as often as they count."""
    rows = expand(weighted(df))
    return rows.select(*[F.col(quoted(c)) for c in columns(rows)], *[F.expr(e).alias(n) for e, n in items], WEIGHT)


def groups_frame(df: DataFrame, fn: str, expression: str, partition: tuple[str, ...], order: tuple[str, ...], start: int | None, end: int | None, name: str) -> DataFrame:
    """The peers' dense rank makes a GROUPS frame a RANGE frame."""
    by = f"partition by {_list(map(quoted, partition))} " if partition else ""
    bound = lambda n, side: f"unbounded {side}" if n is None else "current row" if n == 0 else f"{abs(n)} {'preceding' if n < 0 else 'following'}"
    rows = expand(weighted(df)).withColumn("__peers", F.expr(f"dense_rank() over ({by}order by {_list(order)})"))
    frame = f"{fn}({expression}) over ({by}order by __peers range between {bound(start, 'preceding')} and {bound(end, 'following')})"
    out = rows.withColumn(name, F.expr(frame)).drop("__peers")
    return out.select(*[F.col(quoted(c)) for c in columns(out)], WEIGHT)
