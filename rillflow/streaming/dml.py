"""INSERT ... VALUES, UPDATE and DELETE as weighted deltas."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.zset import WEIGHT, col, columns, consolidate, negate, union
from rillflow.plans.sql import Unsupported, pieces, split


@dataclass(frozen=True)
class Statement:
    kind: str
    table: str
    columns: tuple[str, ...] = ()
    rows: tuple[tuple[str, ...], ...] = ()
    changes: tuple[tuple[str, str], ...] = ()
    predicate: str | None = None


def statements(text: str) -> list[str]:
    """Statements between semicolons that stand outside quotes."""
    return [s for s in split(text, ";") if s]


def parse(text: str) -> Statement:
    t = text.strip().rstrip(";").strip()
    if m := re.match(r"(?is)insert\s+into\s+(\w+)\s*(\(([^()]*)\))?\s*values\s*(.*)$", t):
        rows = []
        for r in split(m[4], ","):
            if not (r.startswith("(") and r.endswith(")")):
                raise Unsupported(f"VALUES takes rows in parentheses, not {r!r}")
            rows.append(tuple(split(r[1:-1], ",")))
        width = len(rows[0])
        names = tuple(c.strip().strip('`"') for c in m[3].split(",")) if m[3] else tuple(f"col{i}" for i in range(width))
        if any(len(r) != len(names) for r in rows):
            raise Unsupported("a row of VALUES has another number of columns")
        for r in rows:
            for v in r:
                if not re.fullmatch(r"(?is)[-+]?\d+(\.\d*)?(e[-+]?\d+)?|[-+]?\.\d+|'(?:[^']|'')*'|true|false|null", v):
                    raise Unsupported(f"VALUES takes literals, not {v!r}")
        return Statement("insert", m[1], names, tuple(rows))
    if m := re.match(r"(?is)delete\s+from\s+(\w+)\s*(.*)$", t):
        return Statement("delete", m[1], predicate=_where(m[2]))
    if m := re.match(r"(?is)update\s+(\w+)\s+set\s+(.*)$", t):
        at = _find_where(m[2])
        sets = []
        for c in split(m[2][:at], ","):
            name, _, value = c.partition("=")
            if not value.strip():
                raise Unsupported(f"SET takes column = value, not {c!r}")
            sets.append((name.strip().strip('`"'), value.strip()))
        return Statement("update", m[1], changes=tuple(sets), predicate=_where(m[2][at:]))
    raise Unsupported("only INSERT ... VALUES, UPDATE and DELETE are supported")


def _find_where(text: str) -> int:
    at = 0
    for t, depth in pieces(text):
        if depth == 0 and t.lower() == "where":
            return at
        at += len(t)
    return at


def _where(text: str) -> str | None:
    text = text.strip()
    if not text:
        return None
    if not re.match(r"(?i)where\b", text):
        raise Unsupported(f"{text!r} is not understood")
    return text[5:].strip()


def values(spark: SparkSession, s: Statement) -> DataFrame:
    """The rows of an INSERT, each with __count 1."""
    rows = ", ".join("(" + ", ".join(re.sub(r"^'(.*)'$", lambda m: "'" + m[1].replace("\\", "\\\\").replace("''", "\\'") + "'", v, flags=re.S) for v in r) + ")" for r in s.rows)
    names = ", ".join(f"`{c}`" for c in s.columns)
    return spark.sql(f"select * from values {rows} as t({names})").withColumn(WEIGHT, F.lit(1).cast("long"))


def delta(spark: SparkSession, s: Statement, table: DataFrame) -> DataFrame:
    """What the statement changes the table by."""
    if s.kind == "insert":
        new = values(spark, s)
        types = dict(table.dtypes)
        given = set(new.columns)
        if unknown := given - set(table.columns):
            raise Unsupported(f"{s.table} has no column {sorted(unknown)[0]}")
        return new.select(*[(col(c) if c in given else F.lit(None)).cast(types[c]).alias(c) for c in columns(table)], WEIGHT)
    hit = table if s.predicate is None else table.where(F.coalesce(F.expr(s.predicate), F.lit(False)))
    if s.kind == "delete":
        return negate(hit)
    types = dict(table.dtypes)
    if unknown := [c for c, _ in s.changes if c not in types]:
        raise Unsupported(f"{s.table} has no column {unknown[0]}")
    new = {c: F.expr(v).cast(types[c]) for c, v in s.changes}
    changed = hit.select(*[new.get(c, col(c)).alias(c) for c in columns(table)], WEIGHT)
    return consolidate(union(negate(hit), changed))
