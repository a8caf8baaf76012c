"""Rows that every operator has to take: nulls, empty and long texts, repeated
rows, ties, and columns with names that operators use themselves."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 977}" for i in range(20_000))
CLASH = "id string, item string, key string, fp string, _gone string, _new string, row string, n string, tokens string, base string, text_ string, value string, y string"


def prose(seed: int, n: int = 80) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(n)) + "."


def documents(spark, rows, clash: bool = True):
    """documents from (doc_id, text) pairs, with clashing columns."""
    names = [c.split()[0] for c in CLASH.split(", ")]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + CLASH if clash else "")
    full = [(i, t, "en", "src0", None if t is None else len(t), *(["x"] * len(names) if clash else [])) for i, t in rows]
    return spark.createDataFrame(full, schema)


def odd_rows():
    return [(1, prose(1)), (2, None), (3, ""), (4, LONG), (5, prose(5)), (5, prose(5)), (None, prose(7)), (7, "x" * 30_000), (8, "日本語 \0 ▁é\n\t"), (9, " \n ")]
