"""Comparisons that take numeric strings as numbers, and casts that do not raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    return c.try_cast("double")


def compare(c: Column, op: str, value) -> Column:
    """c op value, two-valued: false for null. A number compares as a number with
    whatever can be read as one; other values compare as text for = and !=, and
    not at all for an order."""
    ops = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    f = ops[op]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        as_text = f(c.cast("string"), F.lit(str(value))) if op in ("=", "!=", "<>") else F.lit(False)
        return F.coalesce(f(number(c), F.lit(float(value))), as_text, F.lit(False))
    return F.coalesce(f(c.cast("string"), F.lit(str(value))), F.lit(False))


def cast(c: Column, kind: str) -> Column:
    """CAST with null for what cannot be read; numbers lose their fraction."""
    kind = {"bigint": "long", "int": "long", "integer": "long", "double": "double", "float": "double", "varchar": "string", "text": "string", "string": "string"}[kind.lower()]
    return c.try_cast("double").cast("long") if kind == "long" else c.try_cast(kind)
