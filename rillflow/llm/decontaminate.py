"""Benchmark decontamination: pigeonhole edit matching.

A test item of n characters may differ from a passage by e = floor(error_rate x n)
edits. Cut into e + 1 pieces, at least one piece of it is untouched in any such
passage, so that exact piece hits (one Aho-Corasick pass over each text) lose no
match. Around each hit, Myers' bit-parallel algorithm gives the edit distance of
the whole item to the best passage.

Items and texts are compared by their words: lower case, everything else one
space, a space at either end, so that a match starts and ends at words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from rillflow.llm.common import keep_rows, per_batch, text_of

BREAK = re.compile(r"[\W_]+")
BLOCK_CHARS = 4_000_000  # items are matched in blocks of so many characters: the size of one broadcast


def normal(text: str | None) -> str:
    words = BREAK.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def budget(item: str, error_rate: float) -> int:
    return int(error_rate * len(item))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    edges = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


def best_end(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the best match of a pattern of m characters that ends
    at text[:end], the first of the best. It may start anywhere, or, anchored,
    only at the text's start."""
    top, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score, best = full, 0, m, (m, 0)
    for end, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | anchored) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best[0]:
            best = (score, end)
    return best


class Matcher:
    """Finds the passages of one block of items."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float):
        self.items, self.rate = items, error_rate
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, item) in enumerate(items):
            for at, piece in pieces(item, budget(item, error_rate)):
                where[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.empty, self.peq = not where, {}

    def __call__(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, edits, start, end) for each item with a passage within its
        budget, the best one and of equals the first. Offsets count in normal(text)."""
        if self.empty or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (size, places) in self.automaton.iter(text):
            for n, at in places:
                e, begin = budget(self.items[n][1], self.rate), last - size + 1 - at
                lo, hi = max(0, begin - e), begin + len(self.items[n][1]) + e
                seen = windows[n]
                if seen and seen[-1][0] <= lo <= seen[-1][1]:
                    seen[-1] = (seen[-1][0], max(hi, seen[-1][1]))
                else:
                    seen.append((lo, hi))
        found = []
        for n, spans in windows.items():
            id_, item = self.items[n]
            if n not in self.peq:
                self.peq[n] = (masks(item), masks(item[::-1]))
            fore, back = self.peq[n]
            best = None
            for lo, hi in spans:
                d, end = best_end(fore, len(item), text[lo:hi])
                if d <= budget(item, self.rate) and (best is None or (d, lo + end) < best):
                    best = (d, lo + end)
            if best:
                d, end = best
                size = best_end(back, len(item), text[max(0, end - len(item) - d) : end][::-1], anchored=True)[1]
                found.append((id_, d, end - size, end))
        return sorted(found, key=lambda x: (x[2], x[3], x[0] is None, x[0] or 0))


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Distinct items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for r in items.selectExpr("cast(item_id as long) id", "text").distinct().toLocalIterator():
        item = normal(r["text"])
        if not item:
            continue
        if block and size + len(item) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["id"], item))
        size += len(item)
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, error_rate: float = 0.05) -> DataFrame:
    """(doc_id, item_id, edits, start_at, end_at): each row of docs with each item
    that its whole text holds within the item's budget; the best passage, of equal
    ones the first. Offsets are in the normalised text.

    Items are broadcast in blocks of at most BLOCK_CHARS characters, one pass over
    docs for each block. Null or empty texts and items match nothing; repeated
    rows of docs are judged each, repeated items once; null ids stay null; further
    columns play no part. There is no least length: an item of one word, whose budget
    is zero, matches every text with that word; leave such items out of the table if
    that is not wanted.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text")
    schema = "doc_id long, item_id long, edits int, start_at int, end_at int"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def work(shared=shared):
            match = Matcher(shared.value, error_rate)

            def each(batch: pa.RecordBatch) -> dict:
                cols: dict = {k: [] for k in ("doc_id", "item_id", "edits", "start_at", "end_at")}
                for id_, t in zip(batch.column(0).to_pylist(), text_of(batch), strict=True):
                    for m in match(normal(t)):
                        for k, v in zip(cols, (id_, *m), strict=True):
                            cols[k].append(v)
                return cols

            return each

        out = out.union(per_batch(rows, work, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, error_rate: float = 0.05) -> DataFrame:
    """The rows of docs whose text holds no item; judged row by row, so that
    nothing is shuffled. All columns stay as they are."""
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(shared=shared):
            match = Matcher(shared.value, error_rate)
            return lambda batch: [not match(normal(t)) for t in text_of(batch)]

        docs = keep_rows(docs, work)
    return docs
