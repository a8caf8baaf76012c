"""Language-model scores by stupid backoff, computed relationally.

    score(b | a) = count(a b) / count(a)         if a b was seen
                   alpha * count(b) / words      otherwise

A document of the corpus is scored under the model of all other rows: its own counts
are taken off each count first. With them, every n-gram of the corpus would have been
seen, and nothing would ever back off.

All words and bigrams count, each by itself. The corpus' most frequent words, a bounded
number, have short entries that every task gets with their counts; any other word's
entry is a 63-bit hash of it, whose count comes from a table dealt by that hash. Each
document's bigrams are dealt once by the hash of the bigram, in packs, and counted
there over all documents; a bigram then needs the count of one of its words. Bigrams
that might be a hot group (both words are frequent enough for it) are spread over
several parts by document; their counts are added up in the tasks that read them, and
the sums go to each of these parts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from struct import Struct
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import cut, lean, mix64, parts

VOCABULARY = 100_000  # words with a short entry: what is broadcast has this bound
ALPHA = 0.4
START, FIRST = 0, 1  # entries: before the first word, the first word's
HOT = 4  # a bigram that might fill as many thirds of a part is spread
SEED, HIGH = 42, -(1 << 63)  # hashed entries are negative
PACK = 800_000  # words in packs at a time; there is a pack for each part
PIECE = 200_000  # lines of a part that are worked on at a time
ROUND = 5  # pieces that packs are read for at a time
HELD = 1_000_000  # lines of row sums that a task holds
T = TypeVar("T")
HEAD = Struct("<Iq")  # a pack's lines, the first row
CODEC = pa.Codec("zstd")
ALL, SCORED, COUNTED, ROWS = 0, 1, 2, 3  # packs: bigrams to count and score, to score, to count; rows with their ids


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, between ASCII white space."""
    return text.lower().split()


def hashed(word: bytes) -> int:
    return (xxhash.xxh64_intdigest(word, SEED) | 1 << 63) - (1 << 64)


def vocabulary(corpus: DataFrame, size: int = VOCABULARY, text: str = "text") -> tuple[list[tuple[bytes, int]], int, int, DataFrame]:
    """(the most frequent words with their counts, number of words, of texts with
    words, all other words that occur twice or more as (entry, count)), counted over
    all rows. The first are those whose count reaches a bound: the least number of
    four significant binary digits that at most `size` words reach. So no ties are
    cut, and besides the words only the number of words for each such bound comes to
    the driver; the others stay on the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

        count: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                found = words(x.as_py() or b"")
                if found:
                    count.update(found)
                    count[b""] += 1  # stands for the text
            if len(count) > 500_000:
                yield batch()
                count = Counter()
        yield batch()

    partial = corpus.select(F.col(text).cast("binary").alias("text")).mapInArrow(lean(run), "word binary, n long")
    counts = cut(partial.groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where(F.length("word") > 0).agg(F.sum("n")).first()[0] or 0
    texts = counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    low = F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 4, 0)), greatest(length(bin(n)) - 4, 0))")
    sizes = {r["low"]: r["words"] for r in counts.where(F.length("word") > 0).groupBy(low.alias("low")).agg(F.count("*").alias("words")).collect()}
    reach, bound = 0, None
    for at in sorted(sizes, reverse=True):
        reach += sizes[at]
        if reach > size:
            break
        bound = at
    top = [] if bound is None else counts.where((F.length("word") > 0) & (F.col("n") >= bound)).collect()  # at most size words
    rare = counts.where((F.length("word") > 0) & (F.col("n") > 1))
    if bound is not None:
        rare = rare.where(F.col("n") < bound)
    rare = rare.groupBy(F.xxhash64("word").bitwiseOR(F.lit(HIGH)).alias("entry")).agg(F.sum("n").alias("count"))
    return sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda x: (-x[1], x[0])), total, texts, rare


def packs_of(columns: Iterable[np.ndarray], edges: list[int]) -> list[bytes]:
    """Columns of one length, cut at the edges, as bytes: of each cut its length, the
    first value of the first column (which is kept as differences), and like bytes of
    the numbers together; planes of bytes that are zero in all cuts are left out. A cut
    is compressed as one, as there may be very many short ones."""
    starts, planes, some = np.array(edges[:-1], np.int64), [], []
    for i, c in enumerate(columns):
        if i == 0:
            leads = c[starts].tolist()
            c = np.diff(c, prepend=0)
            c[starts] = 0
        split = np.ascontiguousarray(c.astype("<i8", copy=False)).view(np.uint8).reshape(-1, 8)
        used = [j for j in range(8) if split[:, j].any()]
        planes += [split[:, j].copy() for j in used]
        some.append(sum(1 << j for j in used))
    whole = np.stack(planes) if planes else np.zeros((0, edges[-1]), np.uint8)
    return [HEAD.pack(hi - lo, lead) + bytes(some) + CODEC.compress(whole[:, lo:hi].tobytes(), asbytes=True) for lo, hi, lead in zip(edges, edges[1:], leads, strict=False)]


def packed(columns: list[np.ndarray]) -> bytes:
    """One pack; the first column has differences already."""
    return packs_of([np.cumsum(columns[0]), *columns[1:]], [0, len(columns[0])])[0]


def size_of(pack: bytes) -> int:
    return HEAD.unpack_from(pack)[0]


@cache
def used_planes(some: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(some, np.uint8), bitorder="little"))


def unpacked(packs: list[bytes], n_columns: int) -> list[np.ndarray]:
    """The columns of all packs, one after the other."""
    heads = [HEAD.unpack_from(x) for x in packs]
    sizes = np.array([n for n, _ in heads], np.int64)
    ends = np.cumsum(sizes)
    planes = np.zeros((8 * n_columns, int(ends[-1])), np.uint8)
    for pack, (n, _), end in zip(packs, heads, ends.tolist(), strict=True):
        used = used_planes(pack[HEAD.size : HEAD.size + n_columns])
        if len(used):
            planes[used, end - n : end] = np.frombuffer(CODEC.decompress(pack[HEAD.size + n_columns :], len(used) * n, asbytes=True), np.uint8).reshape(len(used), n)
    lead, *rest = (np.ascontiguousarray(c.T).view("<i8").ravel() for c in planes.reshape(n_columns, 8, -1))
    del planes
    lead = np.cumsum(lead)
    lead += np.repeat(np.array([x for _, x in heads], np.int64) - lead[ends - sizes], sizes)
    return [lead, *rest]


def in_groups(packs: Iterable[T], size: Callable[[T], int]) -> Iterator[list[T]]:
    """Packs, as many as have some PIECE // 4 lines together, as packs may be short."""
    group, lines = [], 0
    for x in packs:
        group.append(x)
        lines += size(x)
        if lines >= PIECE // 4:
            yield group
            group, lines = [], 0
    if group:
        yield group


def bigram_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(a.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + b.view(np.uint64))


def pieces(packs: list[tuple[int, bytes]]) -> Iterator[list[np.ndarray]]:
    """(row, first entry, second entry, n, the row's count of either, kind) of the
    lines in packs, which are used up: some PIECE lines at a time, those of a bigram
    together. Lines that wait are there once, for ROUND pieces at a time."""
    some = 1 + sum(size_of(x) for _, x in packs) // PIECE
    for lo in range(0, some, ROUND):
        found = [[] for _ in range(lo, min(lo + ROUND, some))]
        taken = iter(packs) if lo + ROUND < some else iter(lambda: packs.pop() if packs else None, None)
        for group in in_groups(taken, lambda x: size_of(x[1])):
            row, a, b, *small = unpacked([x for _, x in group], 6)  # n and own counts are of one task's words at most
            kind = np.repeat(np.array([k for k, _ in group], np.int8), [size_of(x) for _, x in group])
            columns = [row, a, b, *(c.astype(np.int32) for c in small), kind]
            at = (bigram_key(a, b) & np.uint64(0xFFFFFFFF)) * np.uint64(some) >> np.uint64(32)  # the part is of the key's other half
            for i, x in enumerate(found, lo):
                one = np.flatnonzero(at == i)
                x.append([c[one] for c in columns])
        while found:
            row, a, b, n, own_a, own_b, kind = (np.concatenate(x) for x in zip(*found.pop(), strict=True))
            if len(row):
                yield [row, a, b, *(c.astype(np.int64) for c in (n, own_a, own_b)), kind]


def bigrams(docs: DataFrame, entries: list[bytes], unigrams: list[int], total: int, own: bool, kind: int, n_packs: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(part int, kind int, pack binary): the distinct bigrams of each row as packs of
    (row, first entry, second entry, n, the row's count of either word or, unless own,
    0), a bigram's part being a function of it; and, but for COUNTED, each row's (row,
    doc_id, 1 if it has one) in packs of kind ROWS."""
    shared = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(entries, FIRST)}, np.array(unigrams, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value

        class Entries(dict):
            def __missing__(self, word: bytes) -> int:
                return hashed(word)

        number = Entries(known).__getitem__
        widest = counts * n_packs * 3 // (HOT * max(total, 1)) + 1  # parts that a word's bigrams need

        def spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """In how many parts a bigram is."""
            return np.where((a >= 0) & (b >= 0), np.minimum(widest[np.maximum(a, 0)], widest[np.maximum(b, 0)]), 1)

        def flush(held: list[tuple[int, int | None, np.ndarray]]) -> pa.RecordBatch:
            at, kinds, packs = [], [], []
            rows = np.array([r for r, _, _ in held], np.int64)

            def deal(kind_: int, chosen, part, row, *columns) -> None:
                """The chosen lines; row: places in rows."""
                chosen = chosen[np.argsort(part[chosen] * len(rows) + row[chosen], kind="stable")]
                part = part[chosen]
                edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                if len(part):
                    at.extend(part[edges[:-1]].tolist())
                    kinds.extend([kind_] * (len(edges) - 1))
                    packs.extend(packs_of((c[chosen] if i else rows[c[chosen]] for i, c in enumerate((row, *columns))), edges))

            if kind != COUNTED:
                ids = [np.array([i or 0 for _, i, _ in held]), np.array([i is not None for _, i, _ in held])]
                at, kinds, packs = [held[0][0] % n_packs], [ROWS], packs_of([rows, *ids], [0, len(rows)])
            row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) - 1 for _, _, x in held])
            if len(row):
                a = np.concatenate([x[:-1] for _, _, x in held])
                b = np.concatenate([x[1:] for _, _, x in held])
                times = [np.zeros(len(x), np.int32) for _, _, x in held]
                if own:
                    for t, (_, _, x) in zip(times, held, strict=True):
                        _, back, n = np.unique(x, return_inverse=True, return_counts=True)
                        t[:] = n[back]
                own_a, own_b = np.concatenate([t[:-1] for t in times]), np.concatenate([t[1:] for t in times])
                del times
                key = bigram_key(a, b)
                order = np.argsort(key, kind="stable")  # rows ascend within a key
                key, row = key[order], row[order]
                first = np.flatnonzero((np.diff(key, prepend=~key[:1]) != 0) | (np.diff(row, prepend=-1) != 0))
                n = np.diff(first, append=len(key)).astype(np.int32)
                key, row, order = key[first], row[first], order[first]
                a, b, own_a, own_b = a[order], b[order], own_a[order], own_b[order]
                del order, first, held[:]
                part = ((key >> np.uint64(32)) * np.uint64(n_packs) >> np.uint64(32)).astype(np.int64)
                wide = spread(a, b)
                hot = np.flatnonzero(wide > 1)
                deal(kind, np.flatnonzero(wide == 1), part, row, a, b, n, own_a, own_b)
                if len(hot):
                    key, part, wide, row, a, b, n, own_a, own_b = (c[hot] for c in (key, part, wide, row, a, b, n, own_a, own_b))
                    if kind != COUNTED:
                        salt = (mix64(rows[row].view(np.uint64)) % wide.view(np.uint64)).view(np.int64)
                        deal(SCORED, np.arange(len(row)), (part + salt) % n_packs, row, a, b, n, own_a, own_b)
                    if kind != SCORED:
                        first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
                        sums = np.add.reduceat(n.astype(np.int64), first)
                        part, wide, a, b = part[first], wide[first], a[first], b[first]
                        copy = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
                        zero = np.zeros(len(copy), np.int32)
                        deal(COUNTED, np.arange(len(copy)), (np.repeat(part, wide) + copy) % n_packs, zero, np.repeat(a, wide), np.repeat(b, wide), np.repeat(sums, wide), zero, zero)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(kinds, pa.int32()), pa.array(packs, pa.binary())], ["part", "kind", "pack"])

        held, size = [], 0
        for batch in batches:
            for r, i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.array([START, *map(number, words(x.as_py() or b""))], np.int64)
                held.append((r, i, ids))
                size += len(ids)
                if size >= PACK:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "part int, kind int, pack binary")


class Sums:
    """Sums by row: (n words, of which `back` backed off, log, doc_id, 1 if it has one;
    the last two in one line of a row only). Taken out as packs for as many targets, a
    block of rows' target being a function of it."""

    def __init__(self, targets: int):
        self.targets, self.held, self.size = targets, [], 0

    def add(self, row, n, back, log, ids=None, some=None) -> None:
        zero = np.zeros(len(row), np.int64)
        self.held.append((row, n, back, log, zero if ids is None else ids, zero if some is None else some))
        self.size += len(row)
        if self.size >= HELD // 2 and len(self.held) > 1:
            self.held = [tuple(self.take())]
            self.size = len(self.held[0][0])

    def add_pack(self, *packs: bytes) -> None:
        self.add(*unpacked(list(packs), 6))

    def take(self) -> list[np.ndarray]:
        columns = [list(x) for x in zip(*self.held, strict=True)]
        self.held, self.size = [], 0
        if not columns:
            return list(np.zeros((6, 0), np.int64))
        row = np.concatenate(columns.pop(0))
        order = np.argsort(row, kind="stable")
        row = row[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        found = [row[first]]
        del row
        while columns:  # one at a time, as they are long
            x = np.concatenate(columns.pop(0))[order]
            found.append(np.add.reduceat(x, first) if len(first) else x)
        return found

    def packs(self) -> tuple[list[int], list[bytes]]:
        row, *sums = self.take()
        target = (mix64((row >> 10).view(np.uint64)) % np.uint64(self.targets)).view(np.int64)
        order = np.lexsort((row, target))
        row, target = row[order], target[order]
        if not len(row):
            return [], []
        edges = [0, *(np.flatnonzero(np.diff(target)) + 1).tolist(), len(row)]
        return target[edges[:-1]].tolist(), packs_of((c[order] if i else c for i, c in enumerate((row, *sums))), edges)


def nano_log(x):
    """The logarithm in units of 1e-9, rounded."""
    return np.rint(np.log(x) * 1e9).astype(np.int64)


def looked_up(packs: DataFrame, unigrams: list[int], own: bool, alpha: float, targets: int) -> DataFrame:
    """(entry, row, x, pack) from packs dealt by part. A line whose entry is negative
    waits for that entry's count: the row's score has `times` logarithms of it, once
    `less` is taken off; x is both in one number. Any other line has sums of rows (the
    entry is their target), but for the number of words, which backing off divides by."""
    shared = packs.sparkSession.sparkContext.broadcast(np.array(unigrams, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = shared.value, Sums(targets)

        def lines(entry, row, x, pack) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (entry, row, x)), pa.array(pack, pa.binary())], ["entry", "row", "x", "pack"])

        def waiting(entry, row, less, times) -> pa.RecordBatch:
            order = np.lexsort((row, entry))  # like entries together, as they compress
            entry, row, less, times = (c[order] for c in (entry, row, less, times))
            first = np.flatnonzero((np.diff(entry, prepend=~entry[:1]) != 0) | (np.diff(row, prepend=-1) != 0))
            times = np.add.reduceat(times, first)
            some = first[times != 0]
            return lines(entry[some], row[some], (less[some] << 32) + times[times != 0] + (1 << 31), [None] * len(some))

        def summed() -> pa.RecordBatch:
            at, found = sums.packs()
            return lines(at, [0] * len(at), [0] * len(at), found)

        def judged(of_part: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            for row, a, b, n, own_a, own_b, kind in pieces(of_part):
                key = bigram_key(a, b)
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
                added = np.add.reduceat(np.where(kind == SCORED, 0, n)[order], first)
                both = np.empty(len(key), np.int64)
                both[order] = np.repeat(added, np.diff(first, append=len(key)))
                del key, order, first, added
                if (kind == COUNTED).any():
                    scored = kind != COUNTED
                    row, a, b, n, both, own_a, own_b = (c[scored] for c in (row, a, b, n, both, own_a, own_b))
                both = both - n if own else both
                seen = both > 0
                entry, less, times = np.where(seen, a, b), np.where(seen, own_a, own_b), np.where(seen, -n, n)
                del a, b, own_a, own_b
                log = n * np.where(seen, nano_log(np.maximum(both, 1)), nano_log(alpha))
                rare = entry < 0
                if rare.any():
                    yield waiting(*(c[rare] for c in (entry, row, less, times)))
                log += np.where(rare, 0, times * nano_log(np.maximum(counts[np.maximum(entry, 0)] - less, 1)))
                sums.add(row, n, np.where(seen, 0, n), log)
                if sums.size >= HELD:
                    yield summed()

        held = defaultdict(list)
        for batch in batches:
            for part, kind, pack in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == ROWS:
                    row, ids, some = unpacked([pack], 3)
                    zero = np.zeros(len(row), np.int64)
                    sums.add(row, zero, zero, zero, ids, some)
                else:
                    held[part].append((kind, pack))
        for part in list(held):
            yield from judged(held.pop(part))
        if sums.size:
            yield summed()

    return packs.mapInArrow(lean(run), "entry long, row long, x long, pack binary")


def regrouped(found: DataFrame, targets: int) -> DataFrame:
    """(target int, pack) with sums of rows, from (row, log, pack): packs of sums, or a
    row with a logarithm that has waited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(targets)

        def out() -> pa.RecordBatch:
            at, packs = sums.packs()
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(packs, pa.binary())], ["target", "pack"])

        for batch in batches:
            whole = batch.column(2).is_valid()
            for packs in in_groups(batch.column(2).filter(whole).to_pylist(), size_of):
                sums.add_pack(*packs)
            single = batch.filter(pa.compute.invert(whole))
            row, log = (single.column(i).to_numpy() for i in range(2))
            zero = np.zeros(len(row), np.int64)
            sums.add(row, zero, zero, log)
            if sums.size >= HELD:
                yield out()
        if sums.size:
            yield out()

    return found.mapInArrow(lean(run), "target int, pack binary")


def finished(packs: DataFrame) -> DataFrame:
    """(doc_id, n_words, back, log) of each row, from its target's packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = Sums(1), defaultdict(list)
        for batch in batches:
            for target, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[target].append(pack)
        for target in list(held):
            for packs in in_groups(held.pop(target), size_of):
                sums.add_pack(*packs)
            _, n, back, log, ids, some = sums.take()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=some == 0), *(pa.array(c, pa.int64()) for c in (n, back, log))], ["doc_id", "n_words", "back", "log"])

    return packs.mapInArrow(lean(run), "doc_id long, n_words long, back long, log long")


def score(docs: DataFrame, corpus: DataFrame | None = None, alpha: float = ALPHA, short: int = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of each row of docs under the
    model of all rows of corpus, or, if none is given, of all other rows of docs.

    Every word and bigram of the corpus counts. short bounds how many words have a
    short entry in every task, and does not change a score.

    log_score sums natural logarithms, each rounded to nine decimals, so that the
    sum is the same in any order, and is given to six; mean_log_score is it over
    n_words, null without words. Null and empty texts have no words. Repeated rows
    count for each other and are scored each; null ids stay null; further columns
    play no part. A word that the model has not seen counts as seen once, also with
    an empty corpus.
    """
    spark = docs.sparkSession
    own = corpus is None
    known, total, texts, rare = vocabulary(docs if own else corpus, short)
    entries = [w for w, _ in known]
    unigrams = [texts, *[n for _, n in known]]
    n_parts = parts(spark)
    deal = lambda df, kind: bigrams(df, entries, unigrams, total, own, kind, n_parts)
    packs = deal(docs, ALL) if own else deal(docs, SCORED).union(deal(corpus, COUNTED))
    found = looked_up(packs.repartitionById(n_parts, "part"), unigrams, own, alpha, n_parts).join(rare, "entry", "left")
    # a word that the table lacks occurs once at most, and counts as once
    times, less = F.col("x").bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31), F.shiftright("x", 32)
    log = times * F.rint(F.log(F.greatest(F.coalesce("count", F.lit(1)) - less, F.lit(1))) * 1e9).cast("long")
    packs = regrouped(found.select("row", F.when(F.col("entry") < 0, log).otherwise(0).alias("log"), "pack"), n_parts)
    summed = finished(packs.repartitionById(n_parts, "target")).withColumn("log", F.col("log").cast("decimal(19,0)"))
    words_ = F.greatest(F.lit(total) - (F.col("n_words") if own else F.lit(0)), F.lit(1))
    whole = F.col("log") - F.col("back").cast("decimal(18,0)") * F.rint(F.log(words_) * 1e9).cast("decimal(18,0)")
    scored = summed.withColumn("log_score", F.round((whole / F.lit(10**9).cast("decimal(10,0)")).cast("double"), 6))
    return scored.select("doc_id", "n_words", "log_score", F.round(F.try_divide("log_score", "n_words"), 6).alias("mean_log_score"))


def sql(alpha: float = ALPHA) -> str:
    """DuckDB SQL for score() of the table documents, each row under the model of the
    others. The empty word stands for a text's start."""
    return rf"""
with t as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
tokens as (select *, count(*) over (partition by r, word) own, count(*) over (partition by r) size from (select r, unnest(w) word, generate_subscripts(w, 1) i from t)),
pairs as (select r, size, coalesce(lag(word) over (partition by r order by i), '') a, coalesce(lag(own) over (partition by r order by i), 1) own_a, word b, own own_b from tokens),
own2 as (select r, a, b, size, own_a, own_b, count(*) n from pairs group by all),
all2 as (select a, b, sum(n) n from own2 group by a, b),
all1 as (select word, count(*) n from tokens group by word union all select '', count(*) from t where len(w) > 0),
scored as (select r, own2.n, (case when all2.n > own2.n then round(ln(all2.n - own2.n), 9) - round(ln(ca.n - own_a), 9)
    else round(ln({alpha}), 9) + round(ln(greatest(cb.n - own_b, 1)), 9) - round(ln(greatest((select count(*) from tokens) - size, 1)), 9) end)::decimal(18,9) v
    from own2 join all2 using (a, b) join all1 ca on ca.word = own2.a join all1 cb on cb.word = own2.b),
summed as (select r, sum(n) n, round(sum(v * n)::double, 6) s from scored group by r)
select doc_id, coalesce(n, 0)::bigint n_words, coalesce(s, 0)::double log_score, case when n > 0 then round(s / n, 6) end mean_log_score from t left join summed using (r)"""
