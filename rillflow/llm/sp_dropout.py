"""SentencePiece encoding and decoding with seeded merge-dropout.

A piece model of the merge (BPE) type is applied by an agenda: of all adjacent
pairs whose concatenation is a piece, the one of best score merges first, the
leftmost of equals. Each candidate that is about to merge is skipped instead with
a given probability, decided by a keyed hash of the seed, the document, the
segment's number and the number of the draw: the same input always gives the same
pieces, and each occurrence of a word may be cut another way. Whatever is
skipped, the pieces decode to the very text.

Merges never cross the mark of a space after another character, so that a text is
encoded segment by segment. The draws of a segment are the bits of one number.
Without a skip, a segment of n characters and m pieces needs n - m draws; where
those bits are zero, its pieces are looked up, else its agenda is worked off.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from rillflow.llm.common import MASK64, mix64, per_batch, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MARK = "\0" + SPACE  # stands for a mark in the text itself; no segment is like it
NONE = np.iinfo(np.int32).max
CACHE = 500_000  # distinct segments that a worker remembers
GROUP = 1_000_000  # characters that are encoded together
STEPS = 8  # the probability of a skip is a multiple of 2 ** -STEPS


@dataclass(frozen=True)
class Pieces:
    """What encoding needs of a model."""

    ids: dict[str, int]
    scores: list[float]
    surface: list[bytes]  # a piece's bytes, the mark as a space
    byte_ids: list[int]

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, surface, byte_ids = {}, [], [0] * 256
        for i in range(m.vocab_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(p[1:-1], 16)] = i
                surface.append(bytes([int(p[1:-1], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                surface.append(b"")
            else:
                ids[p] = i
                surface.append(p.replace(SPACE, " ").encode())
        return cls(ids, [m.get_score(i) for i in range(m.vocab_size())], surface, byte_ids)

    @cached_property
    def segment(self) -> re.Pattern:
        """Splits where no merge can happen: before a mark that follows another
        character, and around ASCII characters that no longer piece holds."""
        within = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in within)
        single = f"|[{alone}]" if alone else ""
        return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+{single}")


def draws(keys: np.ndarray, threshold: int) -> np.ndarray:
    """For each key 64 independent bits, each set with probability threshold / 2 ** STEPS."""
    with np.errstate(over="ignore"):
        h = mix64(keys)
        out = np.zeros(len(keys), np.uint64)
        for bit in range(STEPS):  # from the last binary digit of the probability to the first
            one = threshold >> bit & 1
            if one or (threshold & ((1 << bit) - 1)):
                w = h * np.uint64((0x9E3779B97F4A7C15 + 0x5851F42D4C957F2E * bit) & MASK64)
                w ^= w >> np.uint64(29)
                w *= np.uint64(0xBF58476D1CE4E5B9)
                w ^= w >> np.uint64(32)
                out = out | w if one else out & w
    return out


class Types:
    """Distinct segments of a worker, with what they give if nothing is skipped."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.points = np.zeros(0, np.int32)  # code points, one segment after the other
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.merges = np.zeros(0, np.int64)
        self.ids, self.ids_begin, self.ids_size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin[i], ..., begin[i] + size[i] - 1 for each i in turn."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes many texts at once. Short segments are worked on together, a draw
    a round: in numpy, each takes its best candidate, and skips or merges it."""

    SHORT = 21  # at most 3 x 21 candidates come up, for which 64 draws are enough

    def __init__(self, pieces: Pieces, skip: float = 1 / 16, seed: int = 0):
        self.p, self.seed = pieces, seed
        self.threshold = round(skip * (1 << STEPS))
        self.vocab = len(pieces.scores)
        self.of_point = np.arange(0x110000, dtype=np.int32) + self.vocab
        pairs = {}
        for piece, id_ in pieces.ids.items():
            if len(piece) == 1:
                self.of_point[ord(piece)] = id_
            for cut in range(1, len(piece)):
                a, b = pieces.ids.get(piece[:cut]), pieces.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 21 | b] = id_
        order = np.argsort(-np.array(pieces.scores), kind="stable")
        self.rank_of = np.empty(self.vocab, np.int32)
        self.rank_of[order] = np.arange(self.vocab)
        self.by_rank = order.astype(np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        by_key = np.argsort(keys)
        self.keys = np.append(keys[by_key], np.iinfo(np.int64).max)
        self.ranks = np.append(self.rank_of[np.fromiter(pairs.values(), np.int64, len(pairs))[by_key]], NONE).astype(np.int32)
        self.types = Types()

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 21 | np.maximum(b, 0)
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (b >= 0), self.ranks[at], NONE)

    def merge_short(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, their number for each segment), segments in the given order."""
        symbols, counts = np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 13), (13, self.SHORT)):
            some = np.flatnonzero((size > low) & (size <= high))
            for part in np.split(some, range(50_000, len(some), 50_000)):
                if len(part):
                    rows.append((part, self.merge_block(points, begin[part], size[part], bits[part], high)))
        for part, sym in rows:
            counts[part] = (sym >= 0).sum(1)
        starts = np.cumsum(counts) - counts
        symbols = np.zeros(counts.sum(), np.int32)
        for part, sym in rows:
            symbols[ragged(starts[part], counts[part])] = sym[sym >= 0]
        return symbols, counts

    def merge_block(self, points, begin, size, bits, width: int) -> np.ndarray:
        """Symbols of each segment in a row, -1 behind the last."""
        n = len(size)
        sym = np.full((n, width + 1), -1, np.int32)
        row = np.repeat(np.arange(n), size)
        sym[row, ragged(np.zeros(n, np.int64), size)] = self.of_point[points[ragged(begin, size)]]
        rank = np.full((n, width), NONE, np.int32)
        rank[:, : width] = self.pair_ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width)
        rank[sym[:, :-1] < 0] = NONE
        live, draw = np.arange(n), 0
        s, r, left = sym, rank, bits
        columns = np.arange(width + 1)
        while len(live):
            i = r.argmin(1)
            best = r[np.arange(len(i)), i]
            go = best < NONE
            if not go.all():
                sym[live] = s
                live, s, r, left, i, best = live[go], s[go], r[go], left[go], i[go], best[go]
                if not len(live):
                    break
            skipped = (left >> np.uint64(draw)) & np.uint64(1) == 1
            r[skipped, i[skipped]] = NONE
            m = np.flatnonzero(~skipped)
            if len(m):
                at = i[m]
                take = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width)
                moved = np.take_along_axis(s[m], take, 1)
                moved[:, width] = -1
                k = np.arange(len(m))
                moved[k, at] = self.by_rank[best[m]]
                ranks = np.take_along_axis(r[m], np.minimum(take[:, :width], width - 1), 1)
                ranks[:, width - 1] = NONE
                ranks[k, at] = self.pair_ranks(moved[k, at], moved[k, at + 1])
                before = np.flatnonzero(at > 0)
                ranks[before, at[before] - 1] = self.pair_ranks(moved[before, at[before] - 1], moved[before, at[before]])
                s[m], r[m] = moved, ranks
            draw += 1
        return sym

    def merge_long(self, segment: str, bits: int, more) -> list[int]:
        """Symbols of one segment of any length, by a heap. Draw i is bit i of
        bits, then more(i)."""
        part = self.of_point[np.frombuffer(segment.encode("utf-32-le"), np.int32)].tolist()
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []
        pair = dict(zip(self.keys[:-1].tolist(), self.ranks[:-1].tolist(), strict=True)) if not hasattr(self, "pair") else self.pair
        self.pair = pair

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n:
                rank = pair.get(part[i] << 21 | part[j])
                if rank is not None:
                    heapq.heappush(agenda, (rank, i, j, part[i], part[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        used = 0
        while agenda:
            rank, i, j, a, b = heapq.heappop(agenda)
            if part[i] != a or part[j] != b or right[i] != j:
                continue
            skipped = bits >> used & 1 if used < 64 else more(used)
            used += 1
            if skipped:
                continue
            part[i], part[j] = int(self.by_rank[rank]), -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for x in part if x >= 0]

    def with_bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as piece ids: characters that are no piece become their bytes."""
        odd = np.flatnonzero(symbols >= self.vocab)
        if not len(odd):
            return symbols, counts
        spelled = [[self.p.byte_ids[b] for b in chr(x - self.vocab).encode("utf-8", "replace")] for x in symbols[odd].tolist()]
        times = np.ones(len(symbols), np.int64)
        times[odd] = [len(x) for x in spelled]
        out = np.repeat(symbols, times)
        out[ragged((np.cumsum(times) - times)[odd], times[odd])] = [b for x in spelled for b in x]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, times, len(counts)).astype(np.int64)

    def learn(self, new: list[str]) -> None:
        """Adds segments to the types, cut without a skip."""
        t = self.types
        points = np.frombuffer("".join(new).encode("utf-32-le"), np.int32)
        size = np.array([len(x) for x in new], np.int64)
        begin = np.cumsum(size) - size
        symbols, counts = self.merge_short(points, begin, size, np.zeros(len(new), np.uint64))
        long = np.flatnonzero(size > self.SHORT)
        if len(long):  # in place of nothing, which is what they have so far
            lists = [self.merge_long(new[i], 0, lambda _: 0) for i in long]
            full = counts.copy()
            full[long] = [len(x) for x in lists]
            merged = np.zeros(full.sum(), np.int32)
            starts = np.cumsum(full) - full
            merged[ragged(starts[counts > 0], counts[counts > 0])] = symbols
            merged[ragged(starts[long], full[long])] = [x for y in lists for x in y]
            symbols, counts = merged, full
        merges = size - counts
        ids, counts = self.with_bytes(symbols, counts)
        for i, x in enumerate(new):
            t.number[x] = len(t.size) + i
        t.begin = np.append(t.begin, len(t.points) + begin)
        t.size = np.append(t.size, size)
        t.points = np.append(t.points, points)
        t.merges = np.append(t.merges, merges)
        t.ids_begin = np.append(t.ids_begin, len(t.ids) + np.cumsum(counts) - counts)
        t.ids_size = np.append(t.ids_size, counts)
        t.ids = np.append(t.ids, ids)

    def encode_all(self, texts: list[str], doc_ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, number of pieces of each), whole texts. A mark
        that a text itself holds is written as its three bytes, as a piece reads it
        as a space."""
        if len(self.types.number) > CACHE:
            self.types = Types()
        t, find = self.types, self.p.segment.findall
        segments, ends, keys, sizes = [], [], [], []
        for text, doc_id in zip(texts, doc_ids, strict=True):
            before = len(segments)
            if text:
                runs = [x.replace(" ", SPACE) for x in text.split(SPACE)]
                runs[0] = SPACE + runs[0]
                for n, run in enumerate(runs):
                    if n:
                        segments.append(MARK)
                    segments += find(run)
            ends.append(len(segments))
            keys.append(xxhash.xxh64_intdigest(struct.pack("<?q", doc_id is not None, doc_id or 0), self.seed & MASK64))
            sizes.append(len(segments) - before)
        if not segments:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if MARK not in t.number:
            self.learn([MARK])
            t.ids_size[-1], t.merges[-1] = 3, 0
            t.ids = np.append(t.ids[: t.ids_begin[-1]], np.array([self.p.byte_ids[b] for b in SPACE.encode()], np.int32))
        new = [x for x in segments if x not in t.number]
        if new:
            self.learn(list(dict.fromkeys(new)))
        which = np.array(list(map(t.number.__getitem__, segments)), np.int64)
        size = np.array(sizes)
        nth = (np.arange(len(segments)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
        with np.errstate(over="ignore"):
            bits = draws(np.repeat(np.array(keys, np.uint64), size) + nth * np.uint64(0x9E3779B97F4A7C15), self.threshold)
        merges = t.merges[which]
        used = np.where(merges >= 64, np.uint64(MASK64), (np.uint64(1) << np.minimum(merges, 63).astype(np.uint64)) - np.uint64(1))
        touched = np.flatnonzero(((bits & used) != 0) | (merges > 64))
        own_begin, own_size, extra = t.ids_begin[which], t.ids_size[which], t.ids
        if len(touched):
            w = which[touched]
            short = touched[t.size[w] <= self.SHORT]
            symbols, counts = self.merge_short(t.points, t.begin[which[short]], t.size[which[short]], bits[short])
            ids, counts = self.with_bytes(symbols, counts)
            own_begin[short], own_size[short] = len(extra) + np.cumsum(counts) - counts, counts
            extra = np.concatenate([extra, ids])
            long = touched[t.size[w] > self.SHORT]
            if len(long):
                starts = np.searchsorted(np.array(ends), long, "right")
                more_ids = []
                for at, doc in zip(long.tolist(), starts.tolist(), strict=True):
                    first = ends[doc - 1] if doc else 0
                    block = xxhash.xxh64_intdigest(struct.pack("<?qq", doc_ids[doc] is not None, doc_ids[doc] or 0, at - first), self.seed & MASK64)
                    sym = np.array(self.merge_long(segments[at], int(bits[at]), self.later(block)), np.int32)
                    got, _ = self.with_bytes(sym, np.array([len(sym)]))
                    own_begin[at], own_size[at] = len(extra) + sum(map(len, more_ids)), len(got)
                    more_ids.append(got)
                extra = np.concatenate([extra, *more_ids])
        total = np.concatenate([[0], np.cumsum(own_size)])
        edges = total[np.array(ends)]
        return extra[ragged(own_begin, own_size)], np.diff(edges, prepend=0)

    def later(self, block: int):
        """Draw i beyond a segment's first 64."""
        words: dict[int, int] = {}

        def draw(i: int) -> int:
            if i >> 6 not in words:
                words[i >> 6] = int(draws(np.array([(block + (i >> 6)) & MASK64], np.uint64), self.threshold)[0])
            return words[i >> 6] >> (i & 63) & 1

        return draw

    def encode(self, text: str, doc_id: int | None = None) -> list[int]:
        return self.encode_all([text], [doc_id])[0].tolist()


def decode(pieces: Pieces, ids: list[int]) -> str:
    """The text of piece ids; a byte sequence that is no UTF-8 gives U+FFFD."""
    return b"".join([pieces.surface[i] for i in ids])[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, skip: float = 1 / 16, seed: int = 0, model: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_pieces, pieces array<int>, lossless): each row's whole
    text as piece ids; lossless says that decoding them gave the text again.

    skip is rounded to 1/256. Null and empty texts have no pieces. Repeated rows
    (same doc_id and text) get the same pieces; equal texts of other ids may be cut
    otherwise; a null id counts as one more id. Further columns play no part. Bytes
    that are no UTF-8 count as U+FFFD.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))  # of the size of the vocabulary

    def work():
        pieces = shared.value
        encoder = Encoder(pieces, skip, seed)

        def each(batch: pa.RecordBatch) -> dict:
            ids, texts = batch.column(0).to_pylist(), list(text_of(batch))
            found, sizes, at = [], [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= GROUP):
                    chars += len(texts[end])
                    end += 1
                got, size = encoder.encode_all(texts[at:end], ids[at:end])
                found.append(got)
                sizes.append(size)
                at = end
            flat, sizes = np.concatenate(found), np.concatenate(sizes)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            same = [decode(pieces, flat[a:b].tolist()) == t for a, b, t in zip(ends, ends[1:], texts, strict=False)]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            return {"doc_id": batch.column(0), "n_chars": [len(t) for t in texts], "n_pieces": sizes, "pieces": lists, "lossless": same}

        return each

    return per_batch(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text"), work, "doc_id long, n_chars long, n_pieces long, pieces array<int>, lossless boolean")
