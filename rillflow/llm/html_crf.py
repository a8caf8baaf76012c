"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

Each leaf block is a position of the chain, its label main text or not. Emissions
come from the block's ancestor tags, their class, id and role words, and the shape
of its text; transitions from whether neighbours share their parent element. The
weights are fitted by forward-backward on labelled pages, and a page's labels are
the Viterbi path.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillflow.llm import html_samples
from rillflow.llm.common import per_batch, text_of
from rillflow.llm.html_blocks import Block, blocks


def features(b: Block) -> list[str]:
    """Of ancestors and text; none names a word of the text."""
    n = b.text.count(" ") + 1
    out = ["bias", f"in:{b.inside}", f"words:{min(6, n.bit_length())}"]
    out += [f"tag:{t}" for t in b.tags]
    out += [f"label:{x}" for x in b.labels]
    share = b.linked / len(b.text)
    out.append("links:none" if share == 0 else "links:some" if share < 0.5 else "links:most")
    if b.text[-1] in ".!?…":
        out.append("ends")
    if b.text.startswith(("©", "(c)", "Copyright", "copyright")):
        out.append("copyright")
    if not b.labels and not {"article", "main", "nav", "aside", "header", "footer", "form"} & b.tags:
        out.append("plain")
    return out


@dataclass(frozen=True)
class Crf:
    weights: dict[str, float]  # a feature's score for main text over other
    moves: np.ndarray  # [same parent][from][to]


def pair_kinds(page: list[Block]) -> list[int]:
    return [int(a.parent == b.parent) for a, b in zip(page, page[1:], strict=False)]


def viterbi(scores: list[float], kinds: list[int], moves) -> list[int]:
    """The best labels (1 main) for emission scores of label 1 (label 0: zero)."""
    if not scores:
        return []
    zero, one = 0.0, scores[0]
    back = []
    for s, k in zip(scores[1:], kinds, strict=True):
        m = moves[k]
        to0 = (zero + m[0][0], one + m[1][0])
        to1 = (zero + m[0][1], one + m[1][1])
        back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
        zero, one = max(to0), max(to1) + s
    at = int(one > zero)
    out = [at]
    for b in reversed(back):
        at = b[at]
        out.append(at)
    return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 200, rate: float = 0.1, decay: float = 0.002) -> Crf:
    """Maximises the penalised log likelihood of the labels by Adam; gradients are
    feature counts minus their expectation by forward-backward."""
    pages = [p for p in pages if p[0]]
    seen = Counter(f for page, _ in pages for b in page for f in set(features(b)))
    ids = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    rows = [[ids[f] for f in features(b) if f in ids] for page, _ in pages for b in page]
    at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    flat = np.array([i for x in rows for i in x], np.int64)
    labels = np.array([y for _, ys in pages for y in ys])
    longest, count = max(len(p) for p, _ in pages), len(pages)
    place = np.full((count, longest), -1)
    kinds = np.zeros((count, longest - 1), np.int64)
    start = 0
    for i, (page, _) in enumerate(pages):
        place[i, : len(page)] = np.arange(start, start + len(page))
        kinds[i, : len(page) - 1] = pair_kinds(page)
        start += len(page)
    on = place >= 0
    both = on[:, 1:]
    y = np.where(on, labels[place], 0)
    seen_moves = np.zeros((2, 2, 2))
    np.add.at(seen_moves, (kinds[both], y[:, :-1][both], y[:, 1:][both]), 1)
    w, moves = np.zeros(len(ids)), np.zeros((2, 2, 2))
    m = [np.zeros_like(w), np.zeros_like(moves)]
    v = [np.zeros_like(w), np.zeros_like(moves)]
    lse = np.logaddexp
    for step in range(1, steps + 1):
        score = np.bincount(at, w[flat], len(rows))
        emit = np.where(on, score[place], 0)
        fore, back = np.zeros((count, longest, 2)), np.zeros((count, longest, 2))
        fore[:, 0, 1] = emit[:, 0]
        for t in range(1, longest):
            k = moves[kinds[:, t - 1]]
            new = lse(fore[:, t - 1, :1] + k[:, 0], fore[:, t - 1, 1:] + k[:, 1])
            new[:, 1] += emit[:, t]
            fore[:, t] = np.where(on[:, t, None], new, fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            k = moves[kinds[:, t]]
            ahead = back[:, t + 1].copy()
            ahead[:, 1] += emit[:, t + 1]
            new = lse(k[:, :, 0] + ahead[:, :1], k[:, :, 1] + ahead[:, 1:])
            back[:, t] = np.where(on[:, t + 1, None], new, 0)
        z = lse(fore[:, -1, 0], fore[:, -1, 1])
        p1 = np.exp(fore[:, :, 1] + back[:, :, 1] - z[:, None])
        d_w = np.bincount(flat, (labels - p1[on])[at], len(w)) / count - decay * w
        d_moves = seen_moves.copy()
        ahead = back[:, 1:].copy()
        ahead[:, :, 1] += emit[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(fore[:, :-1, a] + moves[kinds, a, b] + ahead[:, :, b] - z[:, None])
                np.subtract.at(d_moves, (kinds[both], a, b), p[both])
        for i, (x, d) in enumerate(((w, d_w), (moves, d_moves / count - decay * moves))):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            x += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Crf({f: float(w[i]) for f, i in ids.items()}, moves)


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """Blocks and labels of a marked training page."""
    found = blocks(page)
    labels = [int(html_samples.MAIN in b.text) for b in found]
    for b in found:
        b.text = b.text.replace(html_samples.MAIN, "").replace(html_samples.OTHER, "") or "-"
    return found, labels


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train([labelled(p) for p in html_samples.pages()])


def decode(page: list[Block], model: Crf) -> list[int]:
    get = model.weights.get
    return viterbi([sum([get(f, 0.0) for f in features(b)]) for b in page], pair_kinds(page), model.moves.tolist())


def main_text(page: str, model: Crf) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, decode(found, model), strict=True) if keep)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row's whole html, its
    blocks joined by an empty line; empty if there is none. Null html counts as
    empty, bytes that are no UTF-8 as U+FFFD; repeated rows are worked on each,
    null ids and urls stay null, further columns play no part."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())  # some hundred weights

    def work():
        crf = shared.value

        def each(batch: pa.RecordBatch) -> dict:
            texts = [main_text(t, crf) for t in text_of(batch, "html")]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return each

    return per_batch(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as binary) html"), work, "page_id long, url string, text string, n_chars long")
