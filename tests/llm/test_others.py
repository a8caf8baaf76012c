"""WARC, URL filters, HTML extraction, language-model scores and fingerprints."""

import base64
import hashlib
import html
import random

import duckdb
import pytest
import xxhash

from rillflow.llm import backoff_lm, fuzzy, html_blocks, html_crf, html_samples, url_filter, warc
from tests.llm.helpers import LONG, documents, odd_rows, prose
from tests.oracle import rows as plain


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, key string, digest string")


# WARC


def want_records(rows):
    """Sorted; of rows with one payload, the last of those with the largest id is the response."""
    top = {}
    for n, (i, _, h) in enumerate(rows):
        top[h or ""] = max(top.get(h or "", (-1, -1)), (-1 if i is None else i, n))
    out = []
    for n, (i, u, h) in enumerate(rows):
        b, (best, at) = (h or "").encode(), top[h or ""]
        refers = (None if best < 0 else best) if at != n else None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if at == n else "revisit", refers, " ".join((u or "").split())))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [64, 1000, 1 << 20])
def test_warc_round_trip(spark, tmp_path, segment):
    tricky = ["WARC/1.1\r\nContent-Length: 3\r\n\r\n\n\n" + "é" * 5000, "\r\n\r\n\n" * 300, "0\r\n\r\n", "y\n", "\n", "\r", "a\r\n0\r\n\r\nb"]
    rows = [(1, "a", "x"), (2, "b", "x"), (3, None, None), (4, "c", ""), (None, "d", "x"), (20, "e\r\nX: 1", "z"), (20, "e", "z"), (20, "e", "z"), (None, "f", LONG), (None, "f", LONG), (None, None, None)]
    rows += [(100 + i, f"http://h/{i}", t) for i, t in enumerate(tricky)]
    warc.archive(pages(spark, rows).coalesce(1), str(tmp_path / "w"), segment)
    got = warc.catalogue(spark, str(tmp_path / "w")).collect()
    assert sorted([tuple(x)[:6] for x in got], key=str) == want_records(rows) and not [x for x in got if x["problem"]]
    payloads = {x["key"]: bytes(x["payload"]).decode() for x in warc.reassemble(warc.read(spark, str(tmp_path / "w"))).where("type = 'response'").collect()}
    assert all(payloads[str(i)] == (h or "") for i, _, h in rows if i not in (1, None, 3))


@pytest.mark.parametrize("body", [b"1\r\nx\r\n-6\r\nrest", b"+1\r\nx\r\n0\r\n\r\n", b"0x1\r\nx\r\n0\r\n\r\n", b"1_0\r\n" + b"x" * 16 + b"\r\n0\r\n\r\n", b"ff\r\nx\r\n0\r\n\r\n", b"", b"1\r\nx\r\n", b"\r\n"])
def test_broken_chunks_are_refused(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)


def test_good_chunks_are_read():
    assert warc.unchunked(b"A;x=1\r\n0123456789\r\n2 \r\n\r\n\r\n0\r\nTrailer: 1\r\n\r\n") == b"0123456789\r\n"


def test_foreign_and_damaged_archives(spark, tmp_path):
    import gzip

    def rec(version, head, block, length=None):
        return version + b"\r\n" + b"\r\n".join(head) + b"\r\nCONTENT-length: %d\r\n\r\n" % (len(block) if length is None else length) + block + b"\r\n\r\n"

    http = b"HTTP/1.0 200 OK\r\n\r\n"
    data = rec(b"WARC/1.0", [b"warc-type: warcinfo"], b"software: x\r\n")
    data += rec(b"WARC/1.0", [b"warc-type: response", b"WARC-record-id: <a>", b"warc-target-uri: http://a/", b"X-Folded: 1\r\n 2"], http + b"one")
    data += b"garbage\r\nmore garbage\r\n"
    data += rec(b"WARC/1.1", [b"WARC-Type: response", b"WARC-Record-ID: <b>", b"X-Key: no number"], http + b"two")
    data += b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: -5\r\n\r\n"
    data += rec(b"WARC/1.1", [b"WARC-Type: revisit", b"WARC-Record-ID: <d>", b"WARC-Refers-To: <a>"], b"")
    data += rec(b"WARC/1.1", [b"WARC-Type: response", b"WARC-Record-ID: <e>", b"WARC-Segment-Number: x"], http)
    data += rec(b"WARC/1.1", [b"WARC-Type: response", b"WARC-Record-ID: <c>"], http + b"three", 10_000)
    (tmp_path / "w").mkdir()
    with gzip.open(tmp_path / "w" / "x.warc.gz.gz", "wb") as f:
        f.write(data)
    got = [(x["record_type"], x["payload_bytes"], x["problem"]) for x in warc.catalogue(spark, str(tmp_path / "w")).collect()]
    want = [
        ("response", 3, None), (None, None, "a record should begin here"), ("response", 3, None), ("response", None, "the length is missing"),
        ("revisit", 3, None), ("response", None, "the segment's numbers are not numbers"), ("response", None, "the block is cut short"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_engine_digest_is_the_usual_one(spark):
    texts = [b"", b"a", bytes(range(256)) * 40]
    got = spark.createDataFrame([(t,) for t in texts], "p binary").select(warc.sha1_base32(__import__("pyspark.sql.functions", fromlist=["col"]).col("p"))).collect()
    assert [x[0] for x in got] == [warc.digest(t) for t in texts]


def test_warc_finds_damage(spark, tmp_path):
    warc.archive(pages(spark, [(i, "u", prose(i, 200)) for i in range(5)]), str(tmp_path / "w"), 300)
    r = warc.read(spark, str(tmp_path / "w"))
    lost = warc.reassemble(r.where("not (origin is not null and number = 2)")).collect()
    assert {x["problem"] for x in lost} == {"segments are missing"}
    last = warc.reassemble(r.where("total is null")).collect()
    assert {x["problem"] for x in last} == {"the total length differs"}
    headless = warc.reassemble(r.where("origin is not null")).collect()
    assert {x["problem"] for x in headless} == {"segments are missing"}
    shuffled = warc.reassemble(r.orderBy("block")).collect()
    assert {x["problem"] for x in shuffled} == {None}


def test_warc_of_nothing(spark, tmp_path):
    warc.archive(pages(spark, []), str(tmp_path / "w"))
    assert warc.catalogue(spark, str(tmp_path / "w")).count() == 0


def test_chunks():
    for n in (0, 1, 7, 8, 9, 100):
        assert warc.unchunked(warc.chunked(b"\r\n0" * n, 8)) == b"\r\n0" * n
    for broken in (b"5\r\nabc", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


# URL filters


def test_url_filter_equals_sql(spark):
    r = random.Random(3)
    hosts = ["a.example.com", "EXAMPLE.com", "xexample.com", "b.net", "m.example.net", "c.org", "casino.io", "my-casino.io", "casinox.io", "free-bets.io", "h:80"]
    urls = [f"{r.choice(['http', 'x'])}://{r.choice(hosts)}{r.choice(['', '/en/7', '/en/1', '/de/8', '/de/', '/es/a', '/EN/7', '?x', '#y/en/'])}{r.choice(['', '/cheap/pills', '/adult_x', '?a=casino&b=xxx', '#win'])}" for _ in range(200)]
    urls += [None, "", "://", "no scheme casino", "a://b://c/en/", "http://com/en/", "http://.com/en/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, "q://casino", "x", "y")], "page_id long, url string, host string, rule string")
    got = url_filter.judge(df)
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar)")
    c.executemany("insert into pages values (?, ?)", [*enumerate(urls), (None, "q://casino")])
    cursor = c.execute(url_filter.sql())
    names = [d[0] for d in cursor.description]
    assert plain(got.columns, got.collect()) == plain(names, cursor.fetchall())
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_terms():
    judge = url_filter.Judge(url_filter.Policy(strict=("bad",), soft={"a": 1.0, "bb": 0.5, "cc": 0.5}, several=2, weight=1.0, rules=()))
    assert judge.terms("http://bad.BAD-notbad/bb") == (2, ["bb"])
    assert [judge(u)[3] for u in ("x://bad", "x://bb", "x://bb.bb", "x://bb/cc", "x://a", "x://a/bb", "x://abad")] == ["block", "allow", "allow", "block", "allow", "block", "allow"]


# HTML


def test_held_out_pages():
    model = html_crf.default_model()
    found = [(html_crf.decode(b, model), y) for b, y in map(html_crf.labelled, html_samples.pages(150, 7))]
    wrong = sum(a != b for got, want in found for a, b in zip(got, want, strict=True))
    assert wrong <= 0.01 * sum(len(y) for _, y in found)


def test_viterbi_is_the_best_path():
    from itertools import product

    r = random.Random(5)
    for _ in range(30):
        n = r.randint(1, 7)
        scores, kinds = [r.uniform(-3, 3) for _ in range(n)], [r.randrange(2) for _ in range(n - 1)]
        moves = [[[r.uniform(-2, 2) for _ in "ab"] for _ in "ab"] for _ in "ab"]
        value = lambda ys: sum(s * y for s, y in zip(scores, ys, strict=True)) + sum(moves[k][a][b] for k, a, b in zip(kinds, ys, ys[1:], strict=False))  # noqa: E731,B023
        got = html_crf.viterbi(scores, kinds, moves)
        assert value(got) == pytest.approx(max(map(value, product((0, 1), repeat=n))))


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href=/a>Menu</a><li><a href=/b>Other</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy now.</div>
<article><h1>Title &amp; more</h1><p>First   line<br>second &eacute;&#33; &lt;b&gt; a < b<p><b>Open bold text that goes on.<p>Last&nbsp;one, and long enough.</article>
<form><label>Search</label><input></form><section class="comments"><h2>Comments</h2><p>Nice one!</p></section><footer>&copy; us</footer></body></html>"""


def test_a_page():
    want = ["Title & more", "First line second é! <b> a < b", "Open bold text that goes on.", "Last one, and long enough."]
    assert html_crf.main_text(PAGE, html_crf.default_model()) == "\n\n".join(want)


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b", "</p>", "<!--", "<script>", "<p>" * 3000 + "x", "<div>" * 5000 + "deep" + "</div>" * 5000, "<a title='>' b=\">x", "&#0;&bad;&amp", "<p>" + LONG])
def test_any_page(page):
    html_crf.main_text(page, html_crf.default_model())


def test_blocks_hold_all_text():
    r = random.Random(2)
    for p in html_samples.pages(30, 3):
        text = "".join(b.text for b in html_blocks.blocks(p))
        assert text.count(html_samples.MAIN) == p.count(html_samples.MAIN) and text.count(html_samples.OTHER) == p.count(html_samples.OTHER)
    assert r and html.unescape("&lt;") == "<"


def test_extract_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (None, "u", "<p>" + LONG)]
    got = html_crf.extract(pages(spark, rows)).collect()
    assert len(got) == 5 and all(x["n_chars"] == len(x["text"]) for x in got)
    assert [x["text"] for x in got if x["page_id"] in (2, 3)] == ["", ""]
    assert html_crf.extract(pages(spark, [])).count() == 0


# Language model


def sql_rows(docs, **k):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", docs)
    cursor = c.execute(backoff_lm.sql(**k))
    return [d[0] for d in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("short", [50_000, 20, 0])
def test_scores_equal_sql(spark, short):
    """With short entries for all words, some and none; the last rows hold bigrams that
    are spread over several parts."""
    docs = odd_rows() + [(100 + i, prose(i % 7, 30)) for i in range(20)] + [(200, "A a B b a\tA"), (201, "é É")]
    docs += [(300 + i, "the same " * (3000 + i) + f"end{i % 4}") for i in range(12)]
    got = backoff_lm.score(documents(spark, docs), short=short)
    names, want = sql_rows(docs)
    assert plain(got.columns, got.collect()) == plain(names, want)


def test_every_word_has_its_own_count(spark):
    """More words than a broadcast holds."""
    rare = [f"w{i}" for i in range(6_000)]
    docs = [(1, " ".join(rare)), (2, " ".join(rare[:40])), (3, " ".join(f"{a} {b}" for a, b in zip(rare[:30], rare[100:130], strict=True))), (None, "w7 w8 w5999 unknown"), (5, None)]
    docs += [(10 + i, prose(i % 3, 40)) for i in range(9)]
    got = backoff_lm.score(documents(spark, docs), short=1000)
    names, want = sql_rows(docs)
    assert plain(got.columns, got.collect()) == plain(names, want)


def naive_scores(docs, corpus, own):
    from collections import Counter
    from math import log

    split = lambda t: (t or "").lower().split()
    seen = lambda texts: (Counter(w for t in texts for w in [""] * bool(t) + t), Counter(p for t in texts for p in zip([""] + t, t, strict=False)))
    all1, all2 = seen([split(t) for _, t in corpus])
    out = []
    for id_, t in docs:
        w = split(t)
        one, two = seen([w]) if own else (Counter(), Counter())
        n = max(sum(c for x, c in all1.items() if x) - (len(w) if own else 0), 1)
        total = 0.0
        for a, b in zip([""] + w, w, strict=False):
            both = all2[a, b] - two[a, b]
            total += log(both / (all1[a] - one[a])) if both else log(0.4 * max(all1[b] - one[b], 1) / n)
        out.append((str(id_), len(w), pytest.approx(total, abs=1e-4)))
    return sorted(out, key=lambda x: x[:2])


@pytest.mark.parametrize("own", [True, False])
def test_scores_equal_plain_ones(spark, own):
    docs = [(i, prose(i % 5, 12) + f" w{i % 2} the the the") for i in range(15)] + [(90, None), (91, ""), (92, "alone")]
    corpus = docs if own else [(i, prose(i % 4, 20) + " the the w1") for i in range(30)]
    got = backoff_lm.score(documents(spark, docs), None if own else documents(spark, corpus), short=10).collect()
    assert sorted([(str(x["doc_id"]), x["n_words"], x["log_score"]) for x in got], key=lambda x: x[:2]) == naive_scores(docs, corpus, own)


def test_scores_under_another_corpus(spark):
    docs, corpus = documents(spark, [(1, "a b c"), (2, None), (3, "zz")]), documents(spark, [(9, "a b a b"), (8, "a c")])
    from math import log

    got = {x["doc_id"]: x["log_score"] for x in backoff_lm.score(docs, corpus).collect()}
    # start a: 2 of 2; a b: 2 of 3; b c: never, so 0.4 x 1 of 6
    assert got[1] == pytest.approx(log(1) + log(2 / 3) + log(0.4 / 6), abs=1e-6)
    assert got[2] == 0 and got[3] == pytest.approx(log(0.4 / 6), abs=1e-6)
    assert backoff_lm.score(documents(spark, [])).count() == 0
    assert backoff_lm.score(docs, documents(spark, [])).count() == 3


def test_tasks_give_memory_back():
    import os

    import numpy as np

    from rillflow.llm.common import lean

    held = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGESIZE") / 1e6
    last = []

    def run(batches):
        some = [np.ones(6_000) for _ in range(4_000)]  # 192 MB, all but the last freed, which keeps the heap from shrinking
        last.append(some[-1])
        yield from batches

    before = held()
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert held() - before < 60


class Here:
    """A data frame's and a context's place, so that a task's function runs in this process."""

    sparkSession = sparkContext = property(lambda self: self)

    def broadcast(self, value):
        self.value = value
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_part_is_worked_on_in_pieces(monkeypatch):
    """What a task holds for each line is bounded, the sums are the same in pieces of any length."""
    import tracemalloc
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    r, n, size = np.random.default_rng(1), 300, 2700
    packs = []
    for i in range(n):
        row = np.sort(r.integers(i * 800, i * 800 + 800, size))
        a, b = (np.where(r.random(size) < 0.02, -1 - x, x) for x in (r.zipf(1.3, size) % 10_000 for _ in range(2)))
        packs.append(backoff_lm.packed([np.diff(row, prepend=0), a, b, *(r.integers(lo, 5, size) for lo in (1, 0, 0))]))
    kinds = ([backoff_lm.ALL] * 8 + [backoff_lm.SCORED, backoff_lm.COUNTED]) * (n // 10)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(kinds, pa.int32()), pa.array(packs, pa.binary())], ["part", "kind", "pack"])
    run = backoff_lm.looked_up(Here(), list(range(10, 10_010)), True, 0.4, 5)

    def results():
        sums, waits = backoff_lm.Sums(1), Counter()
        for out in run(iter([batch])):
            for entry, row, x, pack in zip(*(c.to_pylist() for c in out.columns), strict=True):
                if pack is None:
                    waits[entry, row] += (x & 0xFFFFFFFF) - (1 << 31)  # times
                else:
                    sums.add_pack(pack)
        return [x.tolist() for x in sums.take()], {k: v for k, v in waits.items() if v}

    found = []
    for piece in (10**9, 5_000):
        monkeypatch.setattr(backoff_lm, "PIECE", piece, raising=False)
        found.append(results())
    assert found[0] == found[1] and len(found[0][0][0]) > 100_000 and found[0][1]
    monkeypatch.undo()
    tracemalloc.start()
    for out in run(iter([batch])):
        del out
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n * size


def test_packs_stay_small_with_many_parts(spark):
    """Each task makes a pack for each part, and the parts grow with the input: what a
    task writes must not grow with them, nor may a line be lost."""
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    class Docs(Here):
        def select(self, *_):
            return self

    r = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in r.zipf(1.2, 500) % 50_000) for _ in range(800)]
    count = Counter(w for t in texts for w in t.encode().split())
    known = count.most_common(1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5, 805)), pa.array(range(800)), pa.array([t.encode() for t in texts])], ["row", "doc_id", "text"])
    size, found = {}, {}
    for n in (30, 2000):
        packs = backoff_lm.bigrams(Docs(), [w for w, _ in known], [800, *[c for _, c in known]], sum(count.values()), True, backoff_lm.ALL, n)
        out = pa.Table.from_batches(packs(iter([batch])))
        assert max(out["part"].to_pylist()) < n
        size[n] = sum(map(len, out["pack"].to_pylist()))
        waits, sums = Counter(), backoff_lm.Sums(1)
        for lines in backoff_lm.looked_up(Here(), [800, *[c for _, c in known]], True, 0.4, n)(iter(out.combine_chunks().to_batches())):
            for entry, row, x, pack in zip(*(c.to_pylist() for c in lines.columns), strict=True):
                if pack is None:
                    waits[entry, row] += (x & 0xFFFFFFFF) - (1 << 31)
                else:
                    sums.add_pack(pack)
        found[n] = [x.tolist() for x in sums.take()], {k: v for k, v in waits.items() if v}
    assert found[30] == found[2000] and sum(found[30][0][1]) == 400_000
    assert size[2000] < 1.5 * size[30]


# Fingerprints


def test_edit_distance():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 70))) for _ in "ab")
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
            before = now
        assert fuzzy.edit_distance(a, b) == before[-1]


def test_fingerprint_depends_on_near_bytes_only():
    text = prose(1, 2000)
    other = text[:4000] + "CHANGED" + text[4000:]
    assert fuzzy.likeness(fuzzy.fingerprint(text), fuzzy.fingerprint(other)) > 0.9
    assert fuzzy.likeness(fuzzy.fingerprint(text), fuzzy.fingerprint(prose(2, 2000))) < 0.3
    assert fuzzy.fingerprint("") == fuzzy.fingerprint("") and fuzzy.likeness(fuzzy.fingerprint(""), fuzzy.fingerprint("")) == 1
    assert len(fuzzy.fingerprint("a" * 300_000)) < 600


def test_all_chunks_count():
    """Repeated lines have hundreds of boundaries at the block size that finds 32."""
    text = (prose(13, 10) + "\n") * 400
    block, one, _ = fuzzy.fingerprint(text).split(":")
    data = text.encode()
    ends = [i + 1 for i, h in enumerate(fuzzy.rolling(data).tolist()) if h % int(block) == int(block) - 1]
    assert len(one) == len(ends) + (ends[-1] < len(data)) > 256
    assert fuzzy.likeness(fuzzy.fingerprint(text), fuzzy.fingerprint(fuzzy.edited(text, prose(99, 5000)))) < 0.9


def test_rolling_hash_sees_the_window_only():
    a, b = fuzzy.rolling(b"0123456789abcdefgh"), fuzzy.rolling(b"XXXXXXXXXXabcdefgh")
    assert (a[-2:] == b[-2:]).all() and not (a[:10] == b[:10]).any()


def plain_fingerprint(text):
    """Byte by byte, from the definition."""
    data = text.encode()
    rolls = []
    for i in range(len(data)):
        h = sum((data[i - back] + 1) * pow(0x01000193, back, 1 << 32) for back in range(min(7, i + 1))) % (1 << 32)
        h ^= h >> 15
        h = h * 0x2C1B3C6D % (1 << 32)
        rolls.append(h ^ h >> 13)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def signed(block):
        out, start = "", 0
        for i, h in enumerate(rolls):
            if h % block == block - 1 or i == len(data) - 1:
                out += symbols[xxhash.xxh32_intdigest(data[start : i + 1]) % 64]
                start = i + 1
        return out

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and sum(h % block == block - 1 for h in rolls) < 32:
        block //= 2
    return f"{block}:{signed(block)}:{signed(2 * block)}"


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_compared_rows(spark, n):
    docs = [(i, prose(i, 5 + 3 * i)) for i in range(n)] + (odd_rows() if n == 40 else [])
    got = sorted(map(tuple, fuzzy.compared(documents(spark, docs)).collect()), key=str)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(((i, t or "") for i, t in docs), key=lambda x: (x[0] is None, -(x[0] or 0), signed(xxhash.xxh64_intdigest(x[1].encode(), 42))))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        other = t[: len(t) - cut] + nxt[:cut]
        a, b, c = map(plain_fingerprint, (t, other, nxt))
        want.append((i, len(t), hashlib.sha256(other.encode()).hexdigest(), a, b, fuzzy.likeness(a, b), fuzzy.likeness(a, c)))
    assert got == sorted(want, key=str)
