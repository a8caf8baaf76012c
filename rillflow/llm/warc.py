"""WARC archives: writing records in segments, and reassembling them.

A record whose block is longer than a limit is written as a first segment and
continuation records, which may come anywhere later in the archives. Reading
groups continuations by the identifier of their origin, orders them by segment
number, verifies the total length, and decodes the chunked transfer framing of
the HTTP message inside.

Archives are the files of one folder, written and read by the engine's text
source with gzip, so that they may lie wherever the engine can write and a lost
executor's part is written again. A record ends with an empty line, as the format
wants; its length comes from its header, never from its content.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import cut, per_batch

VERSION = b"WARC/1.1"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")  # that are read
HEX = re.compile(rb"[0-9A-Fa-f]+")
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 9562's for URLs
SEGMENT = 256 * 1024  # bytes of a block from which on it is cut
CHUNK = 8192  # bytes of a chunk of the transfer framing
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decodes the chunked framing; raises ValueError where it is broken: a size that
    is not of hexadecimal digits only, or a chunk that runs past the body."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = HEX.fullmatch(body[at : max(end, at)].split(b";")[0].strip(b" \t"))
        if end < 0 or not size:
            raise ValueError("chunk size is missing")
        n = int(size[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without its last line end, which the writer adds."""
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)])
    return head + b"\r\n\r\n" + block + b"\r\n"


def segments(headers: list[tuple[str, str]], block: bytes, limit: int = SEGMENT) -> list[bytes]:
    """The records of one block: itself, or segments of at most limit bytes."""
    if len(block) <= limit:
        return [record(headers, block)]
    own = dict(headers)
    out = []
    for n, at in enumerate(range(0, len(block), limit), 1):
        piece, last = block[at : at + limit], at + limit >= len(block)
        if n == 1:
            out.append(record([*headers, ("WARC-Segment-Number", "1")], piece))
        else:
            more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(f"{own['WARC-Record-ID']}#{n}")), ("WARC-Date", own["WARC-Date"]), ("WARC-Segment-Origin-ID", own["WARC-Record-ID"]), ("WARC-Segment-Number", str(n))]
            if "WARC-Target-URI" in own:
                more.append(("WARC-Target-URI", own["WARC-Target-URI"]))
            out.append(record(more + [("WARC-Segment-Total-Length", str(len(block)))] * last, piece))
    return out


def header_value(text: str) -> str:
    """A value for a header line: line ends would break it."""
    return " ".join(text.split())


def write(rows: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Writes one record for each row (id string, key long, uri, payload binary,
    digest, refers_to_id string, refers_to_key long) as WARC archives into the folder
    path. A row with refers_to_id is a revisit: a record without payload that refers
    to the record of that id, with the same digest. Ids name records and are unique."""

    def work():
        def each(batch: pa.RecordBatch) -> dict:
            out = []
            for id_, key, uri, payload, payload_digest, to_id, to_key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisit = to_id is not None
                head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(id_)), ("WARC-Date", DATE), ("WARC-Target-URI", header_value(uri or "")), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http;msgtype=response")]
                if key is not None:
                    head.append(("X-Key", str(key)))
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                if revisit:
                    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(to_id))]
                    if to_key is not None:
                        head.append(("X-Refers-To-Key", str(to_key)))
                    out += segments(head, http, segment)
                else:
                    out += segments(head, http + chunked(payload or b""), segment)
            return {"value": pa.array(out, pa.binary())}

        return each

    records = per_batch(rows.select("id", "key", "uri", "payload", "digest", "refers_to_id", "refers_to_key"), work, "value binary")
    # a string of the engine is any bytes: this cast copies them as they are
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def parse(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header by lower-case name, block, problem or None) of each record in the
    archive's lines (split at \\n, without it). What is no record, a header without a
    length and a block that is cut short give a problem, and the next version line
    begins the next record."""
    head: dict[str, str] | None = None
    last, bad, lost = "", None, False
    for line in lines:
        bare = line.rstrip(b"\r")
        if bare in VERSIONS:
            if head is not None:
                yield head, b"", "the header is cut short"
            head, last, bad, lost = {}, "", None, False
            continue
        if head is None:
            if bare.strip() and not lost:
                lost = True  # told once, up to the next record
                yield {}, b"", "a record should begin here"
            continue
        if bare:
            name, colon, value = bare.partition(b":")
            if bare[:1] in b" \t" and last:  # a folded line
                head[last] += " " + bare.strip().decode("utf-8", "replace")
            elif not colon:
                bad = "a header line has no colon"
            else:
                last = name.strip().decode("utf-8", "replace").lower()
                head[last] = value.strip().decode("utf-8", "replace")
            continue
        size = head.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            yield head, b"", "the length is missing"
            head = None
            continue
        need, got, parts = int(size), 0, []
        while got < need:
            line = next(lines, None)
            if line is None:
                yield head, b"\n".join(parts), "the block is cut short"
                return
            parts.append(line)
            got += len(line) + 1
        block = b"\n".join(parts)
        if len(block) < need:  # the block itself ends with the line's end
            block += b"\n"
        yield head, block[:need], bad
        head = None
    if head is not None:
        yield head, b"", "the header is cut short"


NAMES = {
    "record_id": "warc-record-id", "type": "warc-type", "uri": "warc-target-uri", "key": "x-key", "digest": "warc-payload-digest",
    "refers_to": "warc-refers-to", "refers_to_key": "x-refers-to-key", "origin": "warc-segment-origin-id",
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, uri, key, digest, refers_to, refers_to_key, origin,
    number int, total long, block binary, problem): every record of the archives in
    path, of version 1.0 or 1.1, segments apart; number is null for a record that was
    not cut. Damage gives rows with a problem, see parse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[bytes]:
            for b in batches:
                for x in b.column(0):
                    yield x.as_py()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*NAMES, "number", "total", "block", "problem"])

        def number(text: str | None, most: int) -> int | None:
            return int(text) if text and text.isascii() and text.isdigit() and int(text) < most else None

        kinds = [pa.string()] * len(NAMES) + [pa.int32(), pa.int64(), pa.binary(), pa.string()]
        cols: list[list] = [[] for _ in kinds]
        size = 0
        for head, block, problem in parse(lines()):
            nth, whole = head.get("warc-segment-number"), head.get("warc-segment-total-length")
            n, total = number(nth, 1 << 31), number(whole, 1 << 63)
            if (nth, whole) != (None, None) and problem is None and (n is None or whole is not None and total is None):
                problem = "the segment's numbers are not numbers"
            for c, v in zip(cols, [*map(head.get, NAMES.values()), n, total, block, problem], strict=True):
                c.append(v)
            size += len(block)
            if size > 8_000_000:
                yield batch()
                cols, size = [[] for _ in kinds], 0
        if cols[0]:
            yield batch()

    text = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))  # a gzip file is one task's, in order
    return text.mapInArrow(run, ", ".join(f"{c} string" for c in NAMES) + ", number int, total long, block binary, problem string")


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: (record_id, type, uri, key, digest, refers_to, refers_to_key,
    payload binary, problem string or null).

    Records in one piece take no part in the shuffle. Segments are grouped by
    origin (a record's own pieces only, which its total length bounds), ordered by
    number, and joined once; problem says if the numbers have gaps (or the first is
    missing), the total is not as announced, the chunked framing or the digest is
    broken, or what reading found. A record that the archives hold twice over, under
    one identifier, comes twice, or, if it was cut, once.
    """
    named = ["record_id", "type", "uri", "key", "digest", "refers_to", "refers_to_key"]
    whole = records.where("number is null").select(*named, F.array("block").alias("blocks"), F.col("problem").alias("gap"))
    piece = F.struct("number", "block", "total", "problem", *named)
    joined = records.where("number is not null").groupBy(F.coalesce("origin", "record_id").alias("of")).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    joined = joined.withColumn("p", F.expr("filter(p, (x, i) -> i = 0 or x.number <> p[i - 1].number)"))
    size = F.expr("aggregate(p, 0L, (acc, x) -> acc + length(x.block))")
    total = F.expr("aggregate(p, cast(null as bigint), (acc, x) -> coalesce(x.total, acc))")
    told = F.expr("aggregate(p, cast(null as string), (acc, x) -> coalesce(acc, x.problem))")
    gap = F.when(F.expr("exists(transform(p, (x, i) -> x.number <> i + 1), y -> y)"), "segments are missing").when(total.isNull() | (size != total), "the total length differs")
    rejoined = joined.select(F.element_at("p", 1).alias("a"), F.expr("transform(p, x -> x.block)").alias("blocks"), F.coalesce(told, gap).alias("gap")).select(*[F.col(f"a.{c}").alias(c) for c in named], "blocks", "gap")
    both = whole.unionByName(rejoined)

    def work():
        def each(batch: pa.RecordBatch) -> dict:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names[:-2])}
            payloads, problems = [], []
            for kind, want, blocks, problem in zip(batch.column(1), batch.column(4), batch.column(7), batch.column(8), strict=True):
                kind, want, problem, payload = kind.as_py(), want.as_py(), problem.as_py(), None
                if problem is None:
                    try:
                        head, _, body = b"".join(blocks.as_py()).partition(b"\r\n\r\n")
                        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() and kind != "revisit" else body
                        if kind != "revisit" and want and want.lower().startswith("sha1:") and want[5:] != digest(payload):
                            problem = "the digest differs"
                    except ValueError as e:
                        problem = str(e)
                payloads.append(payload)
                problems.append(problem)
            return cols | {"payload": pa.array(payloads, pa.binary()), "problem": problems}

        return each

    return per_batch(both, work, "record_id string, type string, uri string, key string, digest string, refers_to string, refers_to_key string, payload binary, problem string")


def sha1_base32(payload: Column) -> Column:
    """digest() in the engine: forty bits of the hash at a time become eight of the
    32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Writes one record for each row of pages (page_id, url, html; null html is
    an empty payload). Of rows with equal payloads, that with the largest page_id is
    the response (a null id counts as smallest; of repeated ids, the last row) and all
    others are revisits of it. Every row's record has an identifier of its own."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("key"), F.col("url").cast("string").alias("uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    hashed = rows.withColumn("digest", sha1_base32(F.col("payload")))
    top = F.max(F.struct("key", "row"))
    several = cut(hashed.groupBy("digest").agg(top.alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marked = hashed.join(several, "digest", "left").withColumn("again", F.col("row") != F.col("top.row"))
    name = lambda row: F.concat_ws("/", row.cast("string"), "digest")
    write(marked.select(name(F.col("row")).alias("id"), "key", "uri", F.when(F.col("again"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", F.when(F.col("again"), name(F.col("top.row"))).alias("refers_to_id"), F.when(F.col("again"), F.col("top.key")).alias("refers_to_key")), path, segment)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    problem) of each response, revisit and damaged record in path. Payloads are
    reassembled and decoded, lengths and digests come from them; a revisit's from the
    record that it refers to. A damaged record's type is null if its header is lost;
    one that ends before its payload has no length. An empty folder of archives gives
    an empty result."""
    slim = reassemble(read(spark, path)).where("type in ('response', 'revisit') or problem is not null")
    slim = cut(slim.select("record_id", "type", "uri", F.expr("try_cast(key as bigint)").alias("page_id"), F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"), "refers_to", F.expr("try_cast(refers_to_key as bigint)").alias("to"), F.length("payload").cast("long").alias("payload_bytes"), "problem"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "problem"]
    first = slim.where("type is null or type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("to").alias("refers_to"), F.col("uri").alias("url"), "problem")
    targets = slim.where("type = 'response'").groupBy("record_id").agg(F.max("payload_bytes").alias("full"))
    revisits = slim.where("type = 'revisit'").drop("record_id", "payload_bytes").join(targets, F.col("refers_to") == F.col("record_id"), "left")
    revisits = revisits.select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("to").alias("refers_to"), F.col("uri").alias("url"), F.coalesce("problem", F.when(F.col("full").isNull(), "the record that it refers to is missing")).alias("problem"))
    return first.select(*names).union(revisits.select(*names))
