"""Secret scans with a randomness test battery, in DataFrame functions only.

Three fixed patterns give the base spans. The method adds tokens that look drawn
at random: of each run of token characters, the encoding is inferred (the
smallest alphabet that holds it), its characters become numbers, and three tests
ask whether they are uniform and independent: chi-squared over the alphabet, the
runs test about the middle of the alphabet, and the lag-1 serial correlation.
Their probabilities are combined by Fisher's sum, in which the last two weigh a
fifth: ordinary text differs from random characters in the first, and only
sequences and repetitions in the others.

A token's p-value is the probability that ordinary text of its length and encoding
gets as small a sum, that is, looks as random. Ordinary text is taken as characters
drawn with the collision rates of words, measured in each band of lengths on the
corpus' own tokens of lower-case letters and separators (with a stated prior, so
that a corpus without such tokens has a null, too), or as decimal numbers, whichever
looks more random. The Benjamini-Hochberg rule over all tokens of a band of lengths
in all texts then keeps the expected share of ordinary tokens among the finds under
a level. It needs counts by encoding, length class and rounded sum only.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import cut

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{32,}"}
LEAST = 16  # characters of a token, without padding
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (name, what a token of it looks like, its alphabet in order)
ENCODINGS = (
    ("hex", "[0-9a-f]+|[0-9A-F]+", DIGITS + "abcdef"),
    ("base32", "[A-Z2-7]+", UPPER + "234567"),
    ("base36", "[a-z0-9]+|[A-Z0-9]+", DIGITS + LOWER),
    ("base64", ".+", UPPER + LOWER + DIGITS + "+/"),
)
BANDS = (24, 32, 48, 64)  # lengths at which a new band begins
CLASSES = 48 + 61  # lengths below 64 by themselves, then four classes to a doubling
WEIGHT = 0.2  # of the runs and the serial test
STEPS, TOP = 20, 60  # sums are rounded down to 1/STEPS and end at TOP
LEVEL = 0.05  # expected share of ordinary tokens among the finds of a band
WORDS = (0.0655, 0.00535)  # the prior: chance that two, or three, letters of English text are equal
PRIOR = 50  # tokens that the prior counts as, in each band
NUMBERS = (0.1, 0.01)  # the same for decimal digits


def spans_of(text: Column, pattern: str, kind: str, good) -> Column:
    """Spans (s, e, kind, token) of the pattern's leftmost non-overlapping matches,
    without those for which good(token) is false; [] if there are none.

    The texts between matches come from split, the matches from the same scan, so
    that offsets are running sums of lengths: within blocks of matches, and over
    the blocks.
    """
    block = 256
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<s:int,e:int,kind:int,token:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        s = acc["at"] + x["gap"]
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(KINDS.index(kind)).alias("kind"), x["m"].alias("token")))
        return F.struct(e.alias("at"), F.when(x["m"].isNotNull() & good(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def joined(ps):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / block).cast("int")), lambda i: F.aggregate(F.slice(ps, i * block + 1, F.lit(block)), start, step))
        before = lambda bs: F.aggregate(bs, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        moved = lambda x, by: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["kind"].alias("kind"), x["token"].alias("token"))
        return let(blocks, lambda bs: let(before(bs), lambda at: F.flatten(F.transform(bs, lambda b, i: F.transform(b["out"], lambda x: moved(x, at[i]))))))

    return F.when(text.rlike(pattern), let(parts, joined)).otherwise(none)


def base_spans(text: Column) -> Column:
    good = {"assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8, "access": lambda m: F.length(m) >= 16, "hex": lambda m: F.length(m) >= 32}
    found = F.concat(*[spans_of(text, PATTERNS[k], k, good[k]) for k in KINDS[:3]])
    return F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, to about 1e-7 absolutely and
    a few per cent relatively far out (Abramowitz and Stegun 26.2.17)."""

    def of(v: Column) -> Column:
        x = F.abs(v)
        poly = let(1 / (1 + 0.2316419 * x), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        return let(F.exp(-x * x / 2) * 0.3989422804014327 * poly, lambda tail: F.when(v >= 0, tail).otherwise(1 - tail))

    return let(z, of)


def let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def total(xs: Column, f=lambda x: x) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x).cast("double"))


def surprise(p: Column) -> Column:
    """Fisher's -2 ln p."""
    return -2 * F.log(F.greatest(p, F.lit(1e-30)))


def battery(body: Column, size: Column, alphabet: Column) -> Column:
    """(n, sum, pairs, triples) of a token's characters: their number, the combined
    surprise of the three tests under randomness (TOP if all characters are in one
    half of the alphabet), and the shares of equal pairs and triples in units of 1e-9."""

    def tested(x: Column) -> Column:
        long = lambda v: v.cast("long")
        start = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("last", "s", "squares", "products", "high", "changes")])

        def step(acc, v):
            up = lambda y: long(y > size / 2)  # noqa: E731  above the middle
            known = acc["last"] > 0
            new = {
                "last": v, "s": acc["s"] + v, "squares": acc["squares"] + v * v, "products": acc["products"] + acc["last"] * v,
                "high": acc["high"] + up(v), "changes": acc["changes"] + long(known & (up(v) != up(acc["last"]))),
            }
            return F.struct(*[c.alias(k) for k, c in new.items()])

        done = F.struct(F.aggregate(x, start, step).alias("a"), x[0].alias("first"), F.element_at(x, -1).alias("last"), F.size(x).cast("double").alias("n"))
        return let(done, judged)

    def judged(d: Column) -> Column:
        a, n = d["a"], d["n"]
        counts = F.transform(F.split(alphabet, ""), lambda c: (F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"))
        n1 = a["high"].cast("double")
        n2 = n - n1
        pair = 2 * n1 * n2
        z_runs = (1 + a["changes"] - (pair / n + 1)) / F.sqrt(F.greatest(pair * (pair - n) / (n * n * (n - 1)), F.lit(1e-9)))
        mean = a["s"] / n
        spread = a["squares"] - n * mean * mean
        shared = a["products"] - mean * (2 * a["s"] - d["first"] - d["last"]) + (n - 1) * mean * mean
        z_serial = (shared / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n)

        def finished(c: Column) -> Column:
            two, three = total(c, lambda v: v * v), total(c, lambda v: v * v * v)

            def of(m: Column) -> Column:
                free = (size - 1) / (1 - 1 / n)  # degrees of a gamma distribution with the statistic's mean and variance
                z_chi = (F.cbrt(F.greatest(size * m["two"] / n - n, F.lit(0.0)) / (size - 1)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
                both = lambda z: F.least(2 * upper_tail(F.abs(z)), F.lit(1.0))
                surprises = surprise(upper_tail(z_chi)) + WEIGHT * (surprise(both(z_runs)) + surprise(both(z_serial)))
                pairs = (m["two"] - n) / (n * (n - 1))
                triples = (m["three"] - 3 * m["two"] + 2 * n) / (n * (n - 1) * (n - 2))
                return F.struct(
                    n.cast("long").alias("n"), F.when((n1 == 0) | (n2 == 0), F.lit(float(TOP))).otherwise(surprises).alias("sum"),
                    F.rint(pairs * 1e9).cast("long").alias("pairs"), F.rint(triples * 1e9).cast("long").alias("triples"),
                )

            return let(F.struct(two.alias("two"), three.alias("three")), of)

        return let(counts, finished)

    return let(F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c).cast("long")), tested)


def measured(token: Column) -> Column:
    """(encoding, class, bucket, ordinary, pairs, triples) of a token: the number of
    its encoding (the first that looks like it), its length's class, its rounded sum,
    and, if it has nothing but lower-case letters and separators, 1 and its shares."""

    def of(raw: Column) -> Column:
        which = F.lit(len(ENCODINGS) - 1)
        for i, (_, looks, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
            which = F.when(raw.rlike(f"^(?:{looks})$"), F.lit(i)).otherwise(which)
        return let(which, lambda k: tested(raw, k))

    def tested(raw: Column, k: Column) -> Column:
        alphabet = F.array(*[F.lit(a) for _, _, a in ENCODINGS])[k]
        same_case = F.when(k.isin([i for i, (_, _, a) in enumerate(ENCODINGS) if a.startswith(DIGITS)]), F.lower(raw)).otherwise(raw)
        return let(battery(F.translate(same_case, "-_", "+/"), F.length(alphabet).cast("double"), alphabet), lambda b: found(raw, k, b))

    def found(raw: Column, k: Column, b: Column) -> Column:
        plain = raw.rlike("^[a-z+/_-]+$")
        length_class = F.when(b["n"] < 64, b["n"] - LEAST).otherwise(48 + F.least(F.floor(F.log2(b["n"] / 64) * 4), F.lit(CLASSES - 49)))
        bucket = F.floor(F.least(F.greatest(b["sum"], F.lit(0.0)), F.lit(float(TOP))) * STEPS)
        return F.struct(
            k.alias("encoding"), length_class.cast("int").alias("class"), bucket.cast("int").alias("bucket"), plain.cast("int").alias("ordinary"),
            F.when(plain, b["pairs"]).otherwise(0).alias("pairs"), F.when(plain, b["triples"]).otherwise(0).alias("triples"),
        )

    return let(F.rtrim(token, F.lit("=")), of)


def token_spans(text: Column, base: Column) -> Column:
    """Spans (s, e, and what `measured` says) of all tokens that hold a letter and
    overlap no base span."""
    runs = spans_of(text, TOKEN, "random", lambda m: m.rlike("[A-Za-z]"))
    free = F.filter(runs, lambda t: ~F.exists(base, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return F.transform(free, lambda x: let(measured(x["token"]), lambda m: F.struct(x["s"].alias("s"), x["e"].alias("e"), *[m[c].alias(c) for c in ("encoding", "class", "bucket", "ordinary", "pairs", "triples")])))


def least_length(length_class: int) -> int:
    """The smallest length of a class."""
    return LEAST + length_class if length_class < 48 else math.ceil(64 * 2 ** ((length_class - 48) / 4) - 1e-9)


def band_of(length: int) -> int:
    return sum(length >= b for b in BANDS)


@lru_cache(maxsize=4096)
def null(size: int, n: int, two: float, three: float) -> np.ndarray:
    """For each bucket, the probability that n characters of ordinary text get a sum
    of that bucket or less: characters drawn at random of which two are equal with
    probability `two`, three with `three`.

    Their chi-squared statistic has a known mean and variance, and about a gamma
    distribution (Wilson and Hilferty). The other two tests are taken to see no
    difference from random characters, which is the cautious side.
    """
    mean = size * (1 - two) + n * (size * two - 1)
    variance = (size / n) ** 2 * (2 * n * (n - 1) * (two - two**2) + 4 * n * (n - 1) * (n - 2) * (three - two**2))
    if mean <= 0 or variance <= 0:
        return np.ones(TOP * STEPS + 1)
    free, shape = (size - 1) / (1 - 1 / n), mean**2 / variance
    below = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    chi_part = []
    for bucket in range(TOP * STEPS + 1):  # of one test alone: the statistic that surprises by the bucket's end
        z = -NormalDist().inv_cdf(math.exp(-(bucket + 1) / STEPS / 2))
        chi = (size - 1) * max(z * math.sqrt(2 / (9 * free)) + 1 - 2 / (9 * free), 0) ** 3
        chi_part.append(below(((chi / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * math.sqrt(9 * shape)))
    w = np.arange(TOP * STEPS + 2) / STEPS / WEIGHT / 2
    others = np.diff(1 - np.exp(-w) * (1 + w))  # two tests' surprises: chi-squared with four degrees
    out = np.minimum(np.convolve(others, chi_part)[: TOP * STEPS + 1], 1)
    out[-1] = 1  # this bucket holds all greater sums
    return out


def thresholds(tokens: DataFrame) -> list[int]:
    """For each encoding and length class (as one list) the largest bucket that the
    Benjamini-Hochberg rule of its band takes, -1 if none. tokens has a column
    tokens; what comes to the driver is a line for each encoding, class and bucket."""
    sums = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("ordinary", "pairs", "triples")]
    lines = tokens.select(F.inline("tokens")).groupBy("encoding", "class", "bucket").agg(F.count("*").alias("n"), *sums).collect()
    out = [-1] * (len(ENCODINGS) * CLASSES)
    for band in range(len(BANDS) + 1):
        mine = [r for r in lines if band_of(least_length(r["class"])) == band]
        plain = PRIOR + sum(int(r["ordinary"]) for r in mine)
        two, three = ((PRIOR * w + sum(int(r[c]) for r in mine) / 1e9) / plain for w, c in zip(WORDS, ("pairs", "triples"), strict=True))

        def p_values(encoding: int, length_class: int, words=(round(two, 6), round(three, 6))) -> np.ndarray:
            size, n = len(ENCODINGS[encoding][2]), least_length(length_class)
            return np.maximum(null(size, n, *words), null(size, n, *NUMBERS))

        ranked = sorted((float(p_values(r["encoding"], r["class"])[r["bucket"]]), r["n"]) for r in mine)
        m, taken, most = sum(n for _, n in ranked), 0, -1.0
        for p, n in ranked:
            taken += n
            if p * m <= LEVEL * taken:
                most = p
        for e, c in {(r["encoding"], r["class"]) for r in mine}:
            out[e * CLASSES + c] = int(np.searchsorted(p_values(e, c), most, "right")) - 1
    return out


def added_spans(tokens: Column, most: list[int]) -> Column:
    """The spans of the tokens taken."""
    limit = F.lit(most)
    taken = F.filter(tokens, lambda t: t["bucket"] <= limit[t["encoding"] * CLASSES + t["class"]])
    return F.transform(taken, lambda t: F.struct(t["s"].alias("s"), F.lit(KINDS.index("random")).alias("kind"), t["e"].alias("e")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (s, kind, e) sorted by start, then kind;
    offsets are code points, e exclusive; base has the fixed patterns' spans,
    spans also the battery's.

    Every row of docs gives a row, repeated or not. Null or empty texts have no
    spans; null ids stay null; further columns play no part. A corpus without
    tokens gets base spans only. Runs of fewer than LEAST characters, and those
    without a letter, are no tokens; what the battery can tell apart at which
    length is in the README.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), base_spans(text).alias("base"))
    found = cut(found.select("doc_id", "base", token_spans(F.col("text"), F.col("base")).alias("tokens")))
    both = F.array_sort(F.concat("base", added_spans(F.col("tokens"), thresholds(found))))
    return found.select("doc_id", "base", both.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by mark (overlapping spans by one)
    and n_chars, if there is such a column, brought up to date. Row by row, after
    one pass for the counts; all rows and columns stay, null texts stay null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    most = thresholds(docs.select(let(base_spans(text), lambda base: token_spans(text, base)).alias("tokens")))
    spans = let(base_spans(text), lambda base: F.array_sort(F.concat(base, added_spans(token_spans(text, base), most))))

    def step(acc, x):
        piece = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark)))
        out = F.when(x["s"] >= acc["at"], piece).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    def rebuilt(all_spans):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(all_spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))

    new = F.when(F.col("text").isNotNull(), let(spans, lambda s: F.when(F.size(s) > 0, rebuilt(s)).otherwise(text)))
    made = "_new"
    while made in docs.columns:
        made += "_"
    columns = []
    for name, kind in docs.dtypes:
        if name == "text":
            columns.append(F.col(made).alias("text"))
        elif name == "n_chars":
            columns.append(F.coalesce(F.length(made), F.col("n_chars")).cast(kind).alias("n_chars"))
        else:
            columns.append(F.col(f"`{name}`"))
    return docs.withColumn(made, new).select(*columns)
