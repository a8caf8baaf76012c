"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the
word itself, hashed into a table of fixed size; a text's vector is the mean over
its words; a linear softmax gives the two classes. Embeddings and softmax are
trained jointly in numpy, so that a misspelling never seen in training shares
most of its n-grams with words that were. At scoring time the model is linear in
the table, so that each table row is projected onto the difference of the two
class weights once, and a word needs only the mean of a few numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import keep_rows, per_batch, text_of, values

WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 400_000
LINES = 500_000  # lines (an n-gram of a text) that the fit works on at a time


@dataclass(frozen=True)
class Settings:
    """sample_per_class bounds the labelled rows of each class that the model is
    fitted on (the rows of smallest keyed hash); all else reads every row."""

    sample_per_class: int = 2000
    buckets: int = 1 << 17
    dim: int = 4
    min_n: int = 3
    max_n: int = 5
    min_texts: int = 12
    kept: int = 1500
    epochs: int = 15
    epochs_again: int = 70
    rate: float = 10.0
    decay: float = 1e-3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # a bucket's logit
    bias: float
    settings: Settings


def grams(word: str, s: Settings) -> list[int] | np.ndarray:
    """The buckets of a word: of its distinct n-grams with marked ends, and of itself."""
    w = f"<{word}>"
    hashed = xxhash.xxh32_intdigest
    each = (hashed(g, s.seed) for g in chain((w[i : i + n] for n in range(s.min_n, s.max_n + 1) for i in range(len(w) - n + 1)), (w,)))
    if len(w) < 10_000:
        return [h % s.buckets for h in set(each)]
    return np.unique(np.fromiter(each, np.uint32)) % np.uint32(s.buckets)  # the same, in four bytes each


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def train(texts: Iterator[tuple[str, int]], s: Settings) -> Model:
    """Fits embeddings and softmax by gradient descent with momentum on the whole
    sample, both classes weighing the same, so that a score of 0.5 is where a share
    of one class is worth the same share of the other. (Moved by the log odds of the
    labelled rows, or half of them, the bias let one toxic document in five pass.)

    Three rounds: the first sees every n-gram that enough sample texts have; the
    others start anew on the `kept` n-grams that moved scores most, each weighted
    by how much, which leaves little room to learn single texts by heart. With the
    whole table instead (kept=buckets, min_texts=1, 15 epochs a round) held-out recall
    on check_s falls from 0.9 and more to 0.09. A fifth of the texts is left out of
    the rounds and sets the scale and offset of the scores.
    """
    bags, y, cache = [], [], {}
    for text, label in texts:
        c = Counter(words(text))
        if not c:
            continue
        n, own = sum(c.values()), []
        for w in c:
            g = cache.get(w)
            if g is None:
                g = cache[w] = np.array(grams(w, s), np.int32)
            own.append(g)
        sizes = np.array([len(g) for g in own])
        ids, at = np.unique(np.concatenate(own), return_inverse=True)
        shares = np.bincount(at, np.repeat(np.array(list(c.values())) / n / sizes, sizes))
        bags.append((ids, shares.astype(np.float32)))
        y.append(label)
    cache.clear()
    y = np.array(y, np.float32)
    table = np.zeros(s.buckets, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(table, -30.0 if not len(y) or y.max() == 0 else 30.0, s)
    aside = np.zeros(len(y), bool)
    for label in (0, 1):  # every fifth text of a class only sets the scale of the scores
        aside[np.flatnonzero(y == label)[4::5]] = True
    checks = [(g, v) for (g, v), a in zip(bags, aside, strict=True) if a]
    y_checks, bags, y = y[aside], [x for x, a in zip(bags, aside, strict=True) if not a], y[~aside]
    doc = np.repeat(np.arange(len(y), dtype=np.int32), [len(g) for g, _ in bags])
    gram = np.concatenate([g for g, _ in bags])
    bags = [v for _, v in bags]
    share = np.concatenate(bags)
    bags.clear()
    many = summed(gram, gram, s.buckets, np.ones_like) >= min(s.min_texts, max(1, len(y) // 20))
    rms = np.sqrt(summed(gram, share, s.buckets, lambda v: v.astype(np.float64) ** 2) / len(y))
    base = np.where(many, 1 / np.sqrt(np.maximum(rms, 1e-12)), 0)  # so that rare n-grams learn at a useful pace
    scale, bias = base, 0.0
    for epochs, rate, decay in ((s.epochs, s.rate, s.decay), (s.epochs_again, s.rate / 5, s.decay / 3), (s.epochs_again, s.rate / 5, s.decay / 3)):
        m = (scale > 0)[gram]
        if not m.any():
            break
        doc = doc[m]  # one after the other, as they are long
        gram = gram[m]
        share = share[m]
        logit, bias = descend(doc, gram, share, y, scale, epochs, rate, decay, s)
        table[:] = logit
        effect = np.abs(logit) * rms
        least = np.partition(effect, -s.kept)[-s.kept] if s.kept < len(effect) else 0
        scale = np.where((effect >= least) & (effect > 0), base * effect / max(effect.max(), 1e-30), 0)
    if len(y_checks) and 0 < y_checks.sum() < len(y_checks):
        slope, bias = calibrate(np.array([float(v @ table[g]) for g, v in checks]) + bias, y_checks, bias)
        table *= slope
    return Model(table, float(bias), s)


def summed(at: np.ndarray, x: np.ndarray, size: int, of) -> np.ndarray:
    """np.bincount(at, of(x), size), in the same order but LINES at a time, as it would
    copy both whole in eight bytes a number."""
    out = np.zeros(size)
    for lo in range(0, len(at), LINES):
        np.add.at(out, at[lo : lo + LINES], of(x[lo : lo + LINES]).astype(np.float64))
    return out


def spans(starts: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
    """(first segment, past the last, first line, past the last) of runs of whole
    segments, each run of LINES lines at most unless one segment is longer."""
    edges, at, found = np.append(starts, n), 0, []
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + LINES, "right")) - 1)
        found.append((at, to, int(edges[at]), int(edges[to])))
        at = to
    return found


def calibrate(z: np.ndarray, y: np.ndarray, bias: float) -> tuple[float, float]:
    """(slope of the table, new bias) that make sigmoid(slope x table's part + bias)
    fit y best, both classes weighing the same: logistic regression by Newton's method
    on z in units of its spread, lightly penalised."""
    spread = max(float(z.std()), 1e-9)
    x = np.stack([z / spread, np.ones_like(z)], 1)
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (w * (p - y)) + np.array([1e-3, 0]) * theta
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(h, g)
        theta -= np.clip(step, -2, 2)
    slope = max(float(theta[0]), 0.0) / spread
    return slope, float(theta[1] + slope * bias)


def descend(doc, gram, share, y, scale, epochs: int, rate: float, decay: float, s: Settings):
    """(logit of each bucket, bias): gradient descent with momentum on the whole
    sample, n-gram weights times `scale`; a step that raises the loss is taken
    back and the rate halved."""
    times = summed(gram, gram, s.buckets, np.ones_like)
    used = np.flatnonzero(times)
    at = (np.cumsum(times > 0) - 1).astype(np.int32)[gram]
    own = scale[used].astype(np.float32)
    x = share * own[at]
    norm = float(np.sqrt(summed(doc, x, len(y), np.square).mean()))
    x = (x / norm).astype(np.float32)[:, None]
    order = np.argsort(at, kind="stable")
    doc_by_gram, x_by_gram = doc[order], x[order]
    del order
    doc_starts = np.append(0, np.flatnonzero(doc[1:] != doc[:-1]) + 1)  # texts ascend
    docs = doc[doc_starts]
    gram_starts = (np.cumsum(times[used]) - times[used]).astype(np.int64)
    by_doc, by_gram = spans(doc_starts, len(doc)), spans(gram_starts, len(doc))
    rng = np.random.default_rng(s.seed)
    params = [
        rng.normal(0, 0.1, (len(used), s.dim)).astype(np.float32),  # embeddings
        rng.normal(0, 1, (s.dim, 1)).astype(np.float32) * np.array([[-1, 1]], np.float32),  # softmax
        np.zeros(2, np.float32),
    ]
    pace = (1, 0.1, 0.1)
    target = np.stack([1 - y, y], 1)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)
    moments = [np.zeros_like(q) for q in params]
    mean = np.zeros((len(y), s.dim), np.float32)
    low, best = np.inf, [q.copy() for q in params]
    for _ in range(epochs):
        emb, soft, bias = params
        for a, b, lo, hi in by_doc:
            mean[docs[a:b]] = np.add.reduceat(emb[at[lo:hi]] * x[lo:hi], doc_starts[a:b] - lo)
        z = mean @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-(np.log(np.maximum((p * target).sum(1), 1e-12)) * weight).sum() + decay / 2 * ((emb**2).sum() + (soft**2).sum()))
        if loss > 1.02 * low:
            params, moments = [q.copy() for q in best], [0 * m for m in moments]
            rate, low = rate / 2, np.inf
            continue
        if loss < low:
            low, best = loss, [q.copy() for q in params]
        g = (p - target) * weight[:, None]
        back, slope = g @ soft.T, np.empty_like(emb)
        for a, b, lo, hi in by_gram:
            slope[a:b] = np.add.reduceat(back[doc_by_gram[lo:hi]] * x_by_gram[lo:hi], gram_starts[a:b] - lo)
        slopes = [slope + decay * emb, mean.T @ g + decay * soft, g.sum(0)]
        for i, (q, d) in enumerate(zip(params, slopes, strict=True)):
            moments[i] = 0.9 * moments[i] + d
            q -= rate * pace[i] * moments[i]
    emb, soft, bias = best
    logit = np.zeros(s.buckets, np.float32)
    logit[used] = (emb @ (soft[:, 1] - soft[:, 0])) * own / norm
    return logit, float(bias[1] - bias[0])


def scorer(model: Model):
    known: dict[str, float] = {}
    table = model.table

    def score(text: str) -> float:
        nonlocal known
        found = words(text)
        total = 0.0
        for w in found:
            x = known.get(w)
            if x is None:
                if len(known) >= CACHE_WORDS:
                    known = {}
                g = grams(w, model.settings)
                x = known[w] = float(table[g].mean())
            total += x
        z = model.bias + (total / len(found) if found else 0.0)
        return float(1 / (1 + np.exp(-min(max(z, -60), 60))))

    return score


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), held_out: bool = True) -> Model:
    """Trains on labelled documents, without the held-out fifth unless held_out
    is False. A document labelled several times is toxic if any label says so;
    null labels and ids are ignored. The fit runs as one task over the bounded
    sample; only the table of fixed size comes back.
    """
    spark, s = docs.sparkSession, settings
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    if held_out:
        known = known.where(~is_held_out(F.col("id")))
    picked = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(s.seed)), "id").limit(s.sample_per_class)
        picked = one if picked is None else picked.union(one)
    # at most 2 x sample_per_class rows of two numbers: small enough for every executor
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("text", "y")

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(text_of(b), values(b, "y"), strict=True)

        m = train(rows(), s)
        yield pa.RecordBatch.from_pydict({"table": pa.array([m.table.tobytes()], pa.binary()), "bias": [m.bias]})

    got = sample.repartition(1).mapInArrow(run, "table binary, bias double").collect()
    return Model(np.frombuffer(got[0]["table"], np.float32), got[0]["bias"], s) if got else Model(np.zeros(s.buckets, np.float32), -30.0, s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs, whole texts. An empty or null text
    scores by the bias alone. Repeated rows are scored each; other columns of
    docs play no part. An untrained model (no labels, or of one class only) gives
    scores next to that class."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: settings.buckets floats

    def work():
        one = scorer(shared.value)
        return lambda b: {"doc_id": b.column(0), "score": [one(t) for t in text_of(b)]}

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), work, "doc_id long, score double")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score under the threshold, row by row, with all
    their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        one = scorer(shared.value)
        return lambda batch: [one(t) < threshold for t in text_of(batch)]

    return keep_rows(docs, work)
