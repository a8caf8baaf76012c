"""HTTP ingest: POSTed JSON rows in micro-batches."""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from rillflow.functions.zset import WEIGHT
from rillflow.sources import schema_of


def convert(value, kind: str):
    """A JSON value as its column's type; raises ValueError if it does not fit."""
    if value is None:
        return None
    if kind == "int":
        if isinstance(value, bool) or (isinstance(value, float) and value != int(value)):
            raise ValueError(f"{value!r} is no int")
        return int(value)
    if kind == "float":
        return float(value)
    if kind == "bool":
        if not isinstance(value, bool):
            raise ValueError(f"{value!r} is no bool")
        return value
    return value if isinstance(value, str) else json.dumps(value)


class IngestLog:
    """Rows that were taken and not yet read, in a folder that outlives the driver: a
    file for each request, named by the numbers of its first and its last row."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def entries(self) -> list[tuple[int, int]]:
        found = self._fs.globStatus(self._path(f"{self.path}/*-*.json")) or []
        return sorted(tuple(map(int, f.getPath().getName()[:-5].split("-"))) for f in found)

    def _at(self, first: int, last: int):
        return self._path(f"{self.path}/{first:020d}-{last:020d}.json")

    def append(self, first: int, rows: list[tuple]) -> None:
        temporary = self._path(f"{self.path}/.{first:020d}")
        stream = self._fs.create(temporary, True)
        stream.write(json.dumps(rows).encode())
        stream.close()
        if not self._fs.rename(temporary, self._at(first, first + len(rows) - 1)):
            raise OSError(f"rows from {first} on could not be kept")

    def read(self, first: int, last: int) -> list[tuple[int, tuple]]:
        stream = self._fs.open(self._at(first, last))
        try:
            return [(first + i, tuple(r)) for i, r in enumerate(json.loads(bytes(stream.readAllBytes()).decode()))]
        finally:
            stream.close()

    def forget(self, first: int, last: int) -> None:
        self._fs.delete(self._at(first, last), False)


class HttpSource:
    """Takes a JSON object or array of objects at path, by POST. Rows wait in a queue
    of bounded size: while it is full, requests wait. A batch begins with the first
    row and holds up to batch_size rows; with a delay, it waits so long for more. A
    field __count holds a row's weight.

    With a log, a request is answered once its rows are in it, and rows that no
    batch has had, or whose batch was not kept, come first after a restart. Rows are
    numbered; a request without an answer may have been taken all the same."""

    def __init__(self, spark: SparkSession, hints: dict[str, str], port: int = 8080, path: str = "/ingest", buffer: int = 1000, batch_size: int = 100, delay_ms: int = 0, host: str = "127.0.0.1", log: IngestLog | None = None):
        self.spark, self.hints, self.batch_size, self.delay = spark, hints, batch_size, delay_ms / 1000
        self.schema = schema_of({k: v for k, v in hints.items() if k != WEIGHT}).add(WEIGHT, "long")
        self.queue: queue.Queue = queue.Queue(buffer)
        self.closed = threading.Event()
        self.log, self.origin, self.upto = log, f"http {port} {path}" if log else None, 0
        self.logged = log.entries() if log else []  # oldest first; all those at the start wait to be read
        self.waiting = list(self.logged)
        # numbers rise across restarts, also once the log is empty
        self.next = max([time.time_ns() // 1000, *[last + 1 for _, last in self.logged]])
        self.lock = threading.Lock()
        source = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, code: int, text: str) -> None:
                body = text.encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_POST(self):
                if self.path != path:
                    return self.answer(404, "not found")
                try:
                    data = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                    rows = [source.row(r) for r in (data if isinstance(data, list) else [data])]
                except (ValueError, TypeError, AttributeError) as e:
                    return self.answer(400, f"bad request: {e}")
                try:
                    taken = source.take(rows)
                except Exception as e:
                    return self.answer(500, f"not taken: {e}")
                self.answer(202, f"{len(rows)}") if taken else self.answer(503, "closed")

            def do_GET(self):
                self.answer(405, "POST only")

            do_PUT = do_DELETE = do_GET

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def row(self, r: dict) -> tuple:
        return (*[convert(r.get(f.name), self.hints.get(f.name, "string")) for f in self.schema.fields[:-1]], int(r.get(WEIGHT, 1)))

    def take(self, rows: list[tuple]) -> bool:
        """Logs and queues rows in the order of their numbers; False if the source
        was closed before they were safe."""
        with self.lock:
            if self.closed.is_set():
                return False
            first = self.next
            if self.log and rows:
                self.log.append(first, rows)
                self.logged.append((first, first + len(rows) - 1))
            self.next += len(rows)
            for n, r in enumerate(rows, first):
                while not self.closed.is_set():
                    try:
                        self.queue.put((n, r), timeout=0.2)
                        break
                    except queue.Full:
                        continue
                else:
                    return self.log is not None
            return True

    def _take(self) -> list[tuple[int, tuple]]:
        rows: list[tuple[int, tuple]] = []
        until = None
        while len(rows) < self.batch_size:
            try:
                wait = 0.1 if until is None else until - time.monotonic()
                rows.append(self.queue.get(timeout=wait) if wait > 0 else self.queue.get_nowait())
                until = until or time.monotonic() + self.delay
            except queue.Empty:
                if rows or (self.closed.is_set() and self.queue.empty()):
                    break
        return rows

    def _kept(self) -> None:
        """Forgets the files all of whose rows were read and kept."""
        while self.logged and self.logged[0][1] <= self.upto:
            self.log.forget(*self.logged.pop(0))

    def batches(self, done=()) -> Iterator[DataFrame]:
        self.upto = dict(done).get(self.origin, 0)
        self._kept()
        for at in self.waiting:
            rows = [(n, r) for n, r in self.log.read(*at) if n > self.upto] if at[1] > self.upto else []
            for i in range(0, len(rows), self.batch_size):
                yield self._batch(rows[i : i + self.batch_size])
                self._kept()
        while rows := self._take():
            yield self._batch(rows)
            self._kept()

    def _batch(self, rows: list[tuple[int, tuple]]) -> DataFrame:
        self.upto = rows[-1][0]
        return self.spark.createDataFrame([r for _, r in rows], self.schema)

    def close(self) -> None:
        if not self.closed.is_set():
            self.closed.set()
            self.server.shutdown()
            self.server.server_close()
