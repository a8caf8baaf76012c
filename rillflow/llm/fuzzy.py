"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever it is congruent to
a value modulo the block size, so that an edit changes the chunks that it touches
and no others. A signature has one base-64 character for each chunk. A
fingerprint is `block:signature:signature at twice the block`; the block size is
the smallest of 3, 6, 12, ... at which at most 64 chunks are to be expected, or,
if that leaves fewer than 32, half of it as long as that helps. Two fingerprints
can be compared if a block size of theirs is the same: by the edit distance of
the two signatures.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import cut, parts, text_of

WINDOW, LEAST, LENGTH = 7, 3, 64
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: bytes) -> np.ndarray:
    """A hash of the WINDOW bytes that end at each byte (fewer at the start)."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    h = np.zeros(len(b), np.uint32)
    power = 1
    for back in range(min(WINDOW, len(b))):
        h[back:] += b[: len(b) - back] * np.uint32(power)
        power = power * 0x01000193 & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def signature(data: bytes, h: np.ndarray, block: int) -> str:
    """A character for each chunk; the last holds what follows the last boundary,
    if anything does. All chunks count, however many."""
    ends = np.flatnonzero(h % np.uint32(block) == block - 1) + 1
    edges = [0, *ends.tolist()]
    if edges[-1] < len(data):
        edges.append(len(data))
    return "".join(SYMBOLS[xxhash.xxh32_intdigest(data[a:b]) & 63] for a, b in zip(edges, edges[1:], strict=False))


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "replace")
    h = rolling(data)
    block = LEAST
    while block * LENGTH < len(data):
        block *= 2
    while block > LEAST and np.count_nonzero(h % np.uint32(block) == block - 1) < LENGTH // 2:
        block //= 2
    return f"{block}:{signature(data, h, block)}:{signature(data, h, 2 * block)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel (Myers; Hyyro's form), of what lies between
    the common start and the common end; the shorter one is the pattern, so that a
    very long signature costs little against a short or a like one."""
    start = len(commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(commonprefix((a[::-1], b[::-1])))
    a, b = sorted((a[: len(a) - end], b[: len(b) - end]), key=len)
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph = (ph << 1 | 1) & full
        pv = (mh << 1 & full) | (full & ~(xv | ph))
        mv = ph & xv
    return score


def likeness(one: str, other: str) -> float:
    """0 to 1: one minus the edit distance over the longer signature, at the best
    compatible block size; 0 if there is none. Equal fingerprints give 1."""
    if one == other:
        return 1.0
    a, b = one.split(":"), other.split(":")
    at = {int(a[0]): a[1], 2 * int(a[0]): a[2]}
    to = {int(b[0]): b[1], 2 * int(b[0]): b[2]}
    found = [1 - edit_distance(at[k], to[k]) / max(len(at[k]), len(to[k]), 1) for k in at.keys() & to.keys()]
    return max(found, default=0.0)


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many code points
    from the start of the following text, or all of it if it has fewer."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row's whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in text_of(b)], pa.string())], ["doc_id", "fingerprint"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, "doc_id long, fingerprint string")


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next): each row of docs against its edited text and against
    the next row in descending doc_id (after the last, the first; a single row
    follows itself).

    Null texts count as empty; equal ids are ordered by the hash of their texts; null
    ids come last. An empty table gives an empty result. Further columns play no part.

    The rows are range-partitioned by id, hash and row, so that no id (or null) fills
    a task of its own, which is the one shuffle of texts; a
    row's next is then the next of its task. Only each task's last row has its
    next elsewhere: it waits for the first row of the next task that has rows.
    """
    import hashlib

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def result(id_: int | None, text: str, fp: str, nxt: str, nxt_fp: str) -> tuple:
        other = edited(text, nxt)
        other_fp = fingerprint(other)
        digest = hashlib.sha256(other.encode("utf-8", "replace")).hexdigest()
        return id_, len(text), digest, fp, other_fp, likeness(fp, other_fp), likeness(fp, nxt_fp)

    def batch(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        """Results, and a task's outer rows as (task, place, text) with no result."""
        cols = list(zip(*[(*r, None, None, None) for r in rows], *[(i, None, None, None, None, None, None, task, place, t.encode("utf-8", "replace")) for i, t, task, place in edges], strict=True)) or [[]] * 10
        return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(map(list, cols), kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "task", "place", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.binary()]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, first = TaskContext.get().partitionId(), None, None
        for b in batches:
            out = []
            for id_, text in zip(b.column(0).to_pylist(), text_of(b), strict=True):
                fp = fingerprint(text)
                first = first or (id_, text)
                if held:
                    out.append(result(*held, text, fp))
                held = (id_, text, fp)
            yield batch(out, [])
        if held:
            yield batch([], [(*first, task, "first"), (held[0], held[1], task, "last")])

    order = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    near = cut(rows.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(neighbours, f"{schema}, task int, place string, text binary"))
    tasks = sorted(r["task"] for r in near.where("place = 'first'").select("task").collect())  # one number for each task
    follows = {t: n for t, n in zip(tasks, tasks[1:] + tasks[:1], strict=True)}
    last = near.where("place = 'last'").select("doc_id", "text", "task")
    first = near.where("place = 'first'").select(F.col("text").alias("next"), F.col("task").alias("of"))
    step = F.element_at(F.create_map(*[F.lit(x) for p in follows.items() for x in p]), F.col("task")) if follows else F.col("task")
    outer = last.join(first, step == F.col("of")).select("doc_id", "text", "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [result(i, t, fingerprint(t), n, fingerprint(n)) for i, t, n in zip(b.column(0).to_pylist(), text_of(b), text_of(b, "next"), strict=True)]
            cols = list(zip(*done, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds[:7], strict=True)], names[:7])

    return near.where("place is null").select(*names[:7]).union(outer.mapInArrow(finish, schema))
