"""SimHash near-dedup with BK-trees.

A text's fingerprint has the bits that are set in over half of its shingles'
hashes. Texts of one fingerprint are one item. Items that might lie within the
radius share a shard; each shard gets a BK-tree (children keyed by the integer
Hamming distance to their parent), and a query follows only the edges whose key
is within the radius of its own distance to the node. All trees of a task's
shards are built and searched level by level as one forest in numpy.

Shards. For a small radius r, the bits are cut into r + 2 blocks; two fingerprints
within r bits agree in two blocks at least, so that a shard for each pair of
blocks loses no link. For a large radius (near copies of similarity 0.8 differ in
5 to 17 bits) that would take too many shards; there, bands of min-hashes of the
same shingles deal texts to shards, and an estimate from 128 min-hashes, with a
margin, gives candidates. Items that candidates connect are then dealt with their
whole shingle sets, and a link needs the wanted similarity of these sets, exactly.

A shard by blocks that has more than radius + 1 times `chunk` items is dealt once
more: of the open bits in radius + 1 parts, fingerprints within the radius agree in
one. What still has more than `chunk` items is split: its items are dealt to chunks, and
each pair of chunks is a task's tree and query set of its own, so that no task
ever holds an unbounded group. A task returns a spanning forest of its links,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import MASK64, as_long, connected_components, cut, mix64, parts, per_batch

SEED = 42
SKETCH = 128  # min-hashes of a text's sketch
MARGIN = 0.15  # how far below the wanted similarity its estimate may lie: over four standard errors (0.035 at 0.8)
BAND_ROWS, BANDS = 2, 8  # a pair of similarity 0.8 shares no band with probability (1 - 0.64) ** 8 = 0.0003


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word shingles with repeats: A-Z lower-cased, words between ASCII white
    space, joined by a space; fewer words are one shingle, no words none."""
    w = text.lower().split()  # on bytes, both know only ASCII
    if not w:
        return []
    return [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]


def hashes(text: bytes, words: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, words)], "<u8")


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero for none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCH min-hashes of a set of hashes (zeros for none)."""
    if not len(h):
        return np.zeros(SKETCH, np.uint64)
    keys = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    low = np.full(SKETCH, MASK64, np.uint64)
    h = mix64(np.unique(h))
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 2048):
            low = np.minimum(low, (h[None, at : at + 2048] * keys[:, None]).min(1))
    return low


def fingerprints(docs: DataFrame, words: int = 4, with_sketch: bool = False, text: str = "text", id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """(id, fp long) for each row, whole texts; null counts as empty. with_sketch
    adds body (the 128-bit hash of the word sequence), bands (array of long) and
    sketch (a byte for each min-hash); with_text adds body and the text itself."""

    def work():
        def each(batch: pa.RecordBatch) -> dict:
            out = {"id": batch.column(0), "fp": [], "body": [], "bands": [], "sketch": [], "text": batch.column(1)}
            for x in batch.column(1):
                t = x.as_py() or b""
                h = hashes(t, words)
                out["fp"].append(as_long(fingerprint(h)))
                if with_sketch or with_text:
                    out["body"].append(xxhash.xxh3_128_digest(b" ".join(t.lower().split())))
                if with_sketch:
                    low = sketch(h)
                    rows = low[: BAND_ROWS * BANDS].reshape(BANDS, BAND_ROWS)
                    with np.errstate(over="ignore"):
                        bands = mix64(rows[:, 0] + mix64(rows[:, 1] + np.arange(BANDS, dtype=np.uint64)))
                    out["bands"].append(bands.view(np.int64))
                    out["sketch"].append((mix64(low) >> np.uint64(56)).astype(np.uint8).tobytes())
            return out

        return each

    more = ", body binary, bands array<long>, sketch binary" if with_sketch else ", body binary, text binary" if with_text else ""
    return per_batch(docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")), work, "id long, fp long" + more)


def block_masks(radius: int) -> list[int]:
    """A mask for each pair of radius + 2 blocks of the 64 bits, as signed longs."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [as_long(a | b) for a, b in combinations(blocks, 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    """mask with each of radius + 1 parts of the bits it leaves open: two fingerprints
    within radius bits that agree under the mask agree under one of these too."""
    left = [b for b in range(64) if not mask >> b & 1]
    edges = [len(left) * i // (radius + 1) for i in range(radius + 2)]
    return [as_long(mask & MASK64 | sum(1 << b for b in left[lo:hi])) for lo, hi in zip(edges, edges[1:], strict=False)]


def shards_of_two(rows: DataFrame) -> DataFrame:
    """Rows with their shard's size; an item alone in its shard has no link there."""
    return rows.join(rows.groupBy("n", "key").agg(F.count("*").alias("size")).where("size > 1"), ["n", "key"])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def build_forest(group: np.ndarray, fp: np.ndarray):
    """BK-trees of items sorted by group, one tree for each group.

    Returns (root of each group number, edge codes, their children): an edge from
    p to a child at distance d has code 128 p + d; codes ascend.
    """
    n_groups = int(group[-1]) + 1 if len(group) else 0
    roots = np.full(n_groups, -1, np.int64)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    roots[group[first]] = first
    rest = np.ones(len(fp), bool)
    rest[first] = False
    todo = np.flatnonzero(rest)
    parent = roots[group[todo]]
    codes, children = [], []
    while len(todo):
        code = parent * 128 + popcount(fp[todo] ^ fp[parent])
        order = np.argsort(code, kind="stable")
        todo, code = todo[order], code[order]
        new = np.diff(code, prepend=-1) != 0
        heads = todo[new]
        codes.append(code[new])
        children.append(heads)
        parent = heads[np.cumsum(new) - 1][~new]
        todo = todo[~new]
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    child = np.concatenate(children) if children else np.zeros(0, np.int64)
    order = np.argsort(code)
    return roots, code[order], child[order]


def search_forest(forest, tree_fp: np.ndarray, query_fp: np.ndarray, query_group: np.ndarray, radius: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yields (query, tree item) numbers within the radius. Only edges with a key
    within the radius of the node's own distance are followed."""
    roots, codes, children = forest
    start = roots[query_group]
    sized = np.bincount(query_group[start >= 0], minlength=len(roots)) if len(roots) else np.zeros(0)
    query = np.flatnonzero(start >= 0)
    if not len(query):
        return
    load = np.cumsum(sized[query_group[query]])
    for some in np.split(query, np.searchsorted(load, np.arange(most, load[-1], most))) if load[-1] > most else [query]:
        q, node = some, start[some]
        while len(q):
            d = popcount(query_fp[q] ^ tree_fp[node])
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(codes, node * 128 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(codes, node * 128 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            q = np.repeat(q, n)
            node = children[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n items linked by (a, b): the smallest item that each can reach."""
    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], m)
        np.minimum.at(label, label[b], m)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
        far = label[a] != label[b]
        a, b = a[far], b[far]
    return label


def alike(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    """If two ascending arrays without repeats have that Jaccard similarity."""
    if min(len(one), len(other)) < similarity * max(len(one), len(other)):
        return False
    both = np.intersect1d(one, other, assume_unique=True).size
    return both >= similarity * (len(one) + len(other) - both)


def confirmed(n: int, a: np.ndarray, b: np.ndarray, sets: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the candidate links (a, b) of n rows that are alike, but for links
    within what the ones before them connect."""
    of, good = list(range(n)), []

    def root(x: int) -> int:
        while of[x] != x:
            of[x] = x = of[of[x]]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = root(x), root(y)
        if p != q and alike(np.frombuffer(sets[x], "<u8"), np.frombuffer(sets[y], "<u8"), similarity):
            of[max(p, q)] = min(p, q)
            good.append(k)
    return a[good], b[good]


def link_block(group: np.ndarray, item: np.ndarray, fp: np.ndarray, in_tree: np.ndarray, in_query: np.ndarray, sketches: np.ndarray | None, radius: int, similarity: float, sets: list[bytes] | None = None, exact: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (item, item) of whole groups of rows, sorted by group."""
    t, q = np.flatnonzero(in_tree), np.flatnonzero(in_query)
    forest = build_forest(group[t], fp[t])
    roots = forest[0]
    ok = group[q] < len(roots)
    q = q[ok]
    left, right = [], []
    for a, b in search_forest(forest, fp[t], fp[q], group[q], radius):
        a, b = q[a], t[b]
        a, b = a[a != b], b[a != b]
        if sketches is not None:
            good = np.concatenate([np.zeros(0, bool)] + [(sketches[a[i : i + 50_000]] == sketches[b[i : i + 50_000]]).mean(1) >= similarity for i in range(0, len(a), 50_000)])
            a, b = a[good], b[good]
        left.append(a)
        right.append(b)
    if not left:
        return item[:0], item[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    if sets is not None:
        order = np.unique(np.minimum(a, b) * len(item) + np.maximum(a, b))  # each pair once
        a, b = confirmed(len(item), order // len(item), order % len(item), sets, exact)
    label = spanning(len(item), a, b)
    far = np.flatnonzero(label != np.arange(len(item)))
    return item[far], item[label[far]]


def links(items: DataFrame, radius: int, similarity: float | None = None, chunk: int = 1024, exact: float | None = None) -> DataFrame:
    """Links between items (item long, fp long, and for a similarity bands and
    sketch) as (a, b) pairs that connect all that are within the radius. For an
    exact similarity besides, items have sketch, shingles (ascending hashes) and root
    instead; those of one root are a shard."""
    spark = items.sparkSession
    if similarity is None:
        keys = F.array(*[F.struct(F.lit(i).alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(radius))])
        rows = items.select("item", "fp", F.inline(keys))
        more = []
    elif exact is not None:
        rows = items.select("item", "fp", "sketch", "shingles", F.lit(0).alias("n"), F.col("root").alias("key"))
        more = ["sketch", "shingles"]
    else:
        rows = items.select("item", "fp", "sketch", F.posexplode("bands").alias("n", "key"))
        more = ["sketch"]
    rows = shards_of_two(rows)
    if similarity is None:
        # beyond radius + 1 chunks it takes fewer copies to deal a shard's items by more bits
        masks = block_masks(radius)
        finer = F.array(*[F.array(*[F.lit(m) for m in finer_masks(mask, radius)]) for mask in masks])
        number = lambda i: F.lit(len(masks)) + F.col("n") * (radius + 1) + i
        keys = F.transform(F.element_at(finer, F.col("n") + 1), lambda m, i: F.struct(number(i).alias("n"), F.col("fp").bitwiseAND(m).alias("key")))
        hot = F.col("size") > chunk * (radius + 1)
        rows = rows.where(~hot).unionByName(shards_of_two(rows.where(hot).select("item", "fp", F.inline(keys))))
    k = F.ceil(F.col("size") / chunk).cast("int")
    rows = rows.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("item", F.lit(11)), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("n", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "item", "fp", (F.col("own") <= F.col("other")).alias("tree"), (F.col("own") >= F.col("other")).alias("query"), *more)
    order = ["n", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(table: pa.Table) -> pa.RecordBatch:
            get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            cols = [get(c) for c in order]
            new = np.zeros(table.num_rows, bool)
            for c in cols:
                new |= np.diff(c, prepend=c[0] - 1 if len(c) else 0) != 0
            sk = None
            if more:
                sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            a, b = link_block(np.cumsum(new) - 1, get("item"), get("fp").view(np.uint64), get("tree"), get("query"), sk, radius, similarity or 0, table.column("shingles").to_pylist() if exact is not None else None, exact or 0)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= (100_000 if exact is None else 5_000):  # whole groups only: what follows the last change of group waits
                table = pa.Table.from_batches(held)
                last = [table.column(c)[n - 1].as_py() for c in order]
                same = np.ones(n, bool)
                for c, v in zip(order, last, strict=True):
                    same &= table.column(c).to_numpy() == v
                end = n - int(np.argmin(same[::-1])) if not same.all() else 0
                if end:
                    yield linked(table.slice(0, end))
                held, n = table.slice(end).to_batches(), n - end
        if n:
            yield linked(pa.Table.from_batches(held))

    dealt = rows.repartition(parts(spark), *order).sortWithinPartitions(*order, "item")
    return dealt.mapInArrow(run, "a long, b long")


def with_sets(docs: DataFrame, items: DataFrame, words: int, text: str, id: str) -> DataFrame:
    """(item, fp, sketch, root, shingles) of items (which have the least id, too):
    the text comes from a row of docs with that id, so that exact copies are not
    dealt to one task."""
    rows = fingerprints(docs, words, text=text, id=id, with_text=True).select(F.xxhash64("body", "fp").alias("_item"), F.col("id").alias("_id"), "text")
    found = rows.join(items, (F.col("item") == F.col("_item")) & F.col("least").eqNullSafe(F.col("_id"))).dropDuplicates(["item"])

    def work():
        def each(batch: pa.RecordBatch) -> dict:
            sets = [np.unique(hashes(x.as_py() or b"", words)).tobytes() for x in batch.column(4)]
            return {name: batch.column(i) for i, name in enumerate(["item", "fp", "sketch", "root"])} | {"shingles": sets}

        return each

    return per_batch(found.select("item", "fp", "sketch", "root", "text"), work, "item long, fp long, sketch binary, root long, shingles binary")


def groups(docs: DataFrame, words: int = 4, radius: int = 4, similarity: float | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, fp long, component) for each row of docs: the smallest id that its
    links reach, itself included.

    radius: bits in which linked fingerprints differ at most. Without similarity,
    no link is lost. With it, links also need that Jaccard similarity of shingle
    sets, and radius may be large. Its estimate, with a standard error of 0.035, only
    finds candidates down to MARGIN below it; the sets themselves decide.

    Null or empty texts have fingerprint zero and link like any other. Texts whose
    least id is the same row's id are one node, so that they link; a null id is never
    a component's name while a linked row has an id. An empty table gives an empty
    result.
    """
    prints = cut(fingerprints(docs, words, similarity is not None, text, id))
    if similarity is None:
        items = prints.groupBy("fp").agg(F.min("id").alias("least")).withColumn("item", F.col("fp"))
        key = F.col("fp")
    else:
        key = F.xxhash64("body", "fp")
        items = prints.groupBy(key.alias("item")).agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    items = cut(items)
    if similarity is None:
        found = links(items, radius)
    else:
        low = similarity - MARGIN
        near = items.join(connected_components(links(items, radius, low)), F.col("item") == F.col("node")).select("item", "least", "fp", "sketch", "root")
        found = links(with_sets(docs, near, words, text, id), radius, low, exact=similarity)
    # A node is an item's least id, so that a component's root is its name, and no join
    # deals items by root. Items without an id, if there are any, come after all ids.
    node, kind = F.col("least"), "long"
    if not items.where("least is null").isEmpty():
        kind = "decimal(20,0)"
        node = F.coalesce(node.cast(kind), F.lit(str(3 << 63)).cast(kind) + F.col("item")).cast(kind)
    names = items.select("item", node.alias("name"))
    edges = found.join(names.toDF("a", "from"), "a").join(names.toDF("b", "to"), "b")
    roots = connected_components(edges, "from", "to", kind)
    component = F.coalesce("root", "name")
    if kind != "long":
        component = F.when(component <= F.lit((1 << 63) - 1).cast(kind), component.cast("long"))
    named = cut(names.join(roots, F.col("name") == F.col("node"), "left").select("item", component.alias("component")))
    return prints.withColumn("item", key).join(named, "item").select("id", "fp", "component")


def dedup(docs: DataFrame, words: int = 5, radius: int = 20, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of each group, the document with the
    smallest doc_id stays. Rows that repeat a doc_id are one document and stay or
    go together; rows without doc_id go if their group has a document with one,
    else they all stay. Columns and whole texts are as in docs."""
    g = groups(docs, words, radius, similarity)
    gone = g.where(~F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
