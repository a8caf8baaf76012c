"""Versioned state of incremental queries.

A table of state is a list of runs, oldest first. A tick appends one run of what
it changes, and reads of the runs only what has a key that the tick touches: rows
lie ordered by a hash of their key, in slices by the hash's highest bits, so that
whole slices, files and row groups are passed over. A new run takes in the runs
before it that are not over twice as long; so each row is written some
log(rows / rows a tick) times in all, and there are that many runs.

Each tick ends with one manifest that names the runs: a tick either counts wholly
or not at all, and a tick that is run again with the same number gives what it
gave before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from rillflow.functions.zset import col

LAYOUT = 2
PLAIN = "UTF8_BINARY"
HASH, SLICE, RUN = "__h", "__b", "__run"
FILE_ROWS = 1_000_000
SLICE_BITS = 14
FEW = 1_000  # so many key hashes at most are sent to the driver; beyond, only slices

Key = Iterable[tuple[str, str | None]]


def key_hash(df: DataFrame, key: Key) -> Column:
    """Of the columns (each cast to a type, if one is given); a null is a value.
    Strings that are equal without being the same (collations) are left out."""
    cols = [(c, t) for c, t in key if getattr(df.schema[c].dataType, "collation", PLAIN) == PLAIN]
    return F.xxhash64(*[col(c).cast(t) if t else col(c) for c, t in cols]) if cols else F.lit(0).cast("long")


def slice_of(h: Column, bits: int) -> Column:
    return F.shiftright(h, 64 - bits).cast("int")


def numbered(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.drop(HASH, SLICE).withColumn(RUN, F.lit(i)) for i, r in enumerate(runs)])


class StateStore:
    """Parquet tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, plan_key: str, keep: int = 2):
        self.spark, self.path, self.plan_key, self.keep = spark, path.rstrip("/"), plan_key, keep
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest = self._load()
        if self.manifest["plan"] != plan_key:
            raise ValueError(f"{path} holds the state of another plan")
        if self.manifest["layout"] != LAYOUT:
            raise ValueError(f"{path} holds state of another layout")
        self.staged: dict = {}
        self._run = ""

    @property
    def version(self) -> int:
        """The last tick that counts; -1 before the first."""
        return self.manifest["version"]

    @property
    def position(self) -> dict[str, int]:
        """What the versions so far have read: files by table and origin, or up to
        which row of an origin."""
        return self.manifest.get("position") or {}

    @property
    def sent(self) -> int:
        """The last version whose output the sink has."""
        at = self._path(f"{self.path}/sent")
        if not self._fs.exists(at):
            return -1
        stream = self._fs.open(at)
        try:
            return int(bytes(stream.readAllBytes()).decode() or -1)
        finally:
            stream.close()

    def mark_sent(self, version: int) -> None:
        self._put(self._path(f"{self.path}/sent"), str(version))

    def _put(self, at, text: str) -> None:
        stream = self._fs.create(at, True)
        stream.write(text.encode())
        stream.close()

    def _load(self) -> dict:
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*.json"))
        names = sorted(str(f.getPath().getName()) for f in found) if found is not None else []
        if not names:
            return {"version": -1, "plan": self.plan_key, "layout": LAYOUT, "tables": {}, "output": None}
        stream = self._fs.open(self._path(f"{self.path}/{names[-1]}"))
        try:
            return {"layout": 1} | json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def begin(self) -> None:
        self.staged, self._run = {}, f"{self.version + 1}-{uuid.uuid4().hex[:8]}"

    def _write(self, name: str, df: DataFrame) -> tuple[str, DataFrame]:
        at = f"{self.path}/tables/{name}/{self._run}"
        df.write.mode("overwrite").parquet(at)
        return at, self.spark.read.schema(df.schema).parquet(at)

    def _run_rows(self, run: dict) -> DataFrame:
        schema = StructType.fromJson(run["schema"])
        if run["bits"]:
            schema = schema.add(SLICE, IntegerType())
        return self.spark.read.schema(schema).parquet(run["path"])

    def whole(self, name: str) -> DataFrame | None:
        """All rows of all runs, each with its run's number."""
        return self._union(self.manifest["tables"].get(name) or [])

    def _union(self, runs: list[dict]) -> DataFrame | None:
        return numbered([self._run_rows(r) for r in runs]) if runs else None

    def near(self, name: str, keys: DataFrame, key: Key) -> DataFrame | None:
        """The rows whose key's hash is that of one of `keys`, each with its run's
        number: all rows with these keys, and few others. `key` names and casts the
        columns of `keys`. A few hashes go into the scan's filter; of many, the
        slices do, 2 ** SLICE_BITS of them at most, and a semi-join does the rest."""
        runs = self.manifest["tables"].get(name) or []
        if not runs:
            return None
        wanted = keys.select(key_hash(keys, key).alias("__w")).distinct()
        few = [r[0] for r in wanted.limit(FEW + 1).collect()]
        bits = max(r["bits"] for r in runs)
        slices = None
        if len(few) > FEW and bits:
            slices = [r[0] for r in wanted.select(slice_of(F.col("__w"), bits)).distinct().collect()]
        parts = []
        for r in runs:
            df = self._run_rows(r)
            if r["bits"]:
                at = {h >> (64 - r["bits"]) for h in few} if slices is None else {s >> (bits - r["bits"]) for s in slices}
                df = df.where(F.col(SLICE).isin(sorted(at)))
            if len(few) <= FEW:
                df = df.where(F.col(HASH).isin(few))
            else:
                df = df.join(wanted, F.col(HASH) == F.col("__w"), "left_semi")
            parts.append(df)
        return numbered(parts)

    def append(self, name: str, df: DataFrame, key: Key, merge: Callable[[DataFrame, bool], DataFrame]) -> None:
        """A run of df, which has been written before (see hold). merge(rows, all)
        joins runs, given each row's run number, and whether no older run is left."""
        runs, rows = list(self.manifest["tables"].get(name) or []), df.count()
        if not rows:
            return
        joined = []
        while runs and runs[-1]["rows"] <= 2 * rows:
            joined.insert(0, runs.pop())
            rows += joined[0]["rows"]
        if joined:
            older = self._union(joined)
            df = merge(older.unionByName(df.withColumn(RUN, F.lit(len(joined)))), not runs)
        bits = min(SLICE_BITS, (rows // FILE_ROWS).bit_length())
        out, names = df.withColumn(HASH, key_hash(df, key)), df.columns
        schema = out.schema
        if bits:
            # a key of very many rows is spread by a hash of the whole row
            out = out.withColumn(SLICE, slice_of(F.col(HASH), bits)).withColumn("__r", F.xxhash64(*[col(c) for c in names]))
            out = out.repartitionByRange(rows // FILE_ROWS + 1, HASH, "__r").drop("__r").sortWithinPartitions(SLICE, HASH)
        else:
            out = out.coalesce(1).sortWithinPartitions(HASH)
        at = f"{self.path}/tables/{name}/{self._run}"
        writer = out.write.mode("overwrite")
        (writer.partitionBy(SLICE) if bits else writer).parquet(at)
        run = {"path": at, "bits": bits, "schema": schema.jsonValue(), "rows": rows}
        if joined:
            run["rows"] = self._run_rows(run).count()
        self.staged[name] = [*runs, run]

    def put(self, name: str, df: DataFrame | None) -> DataFrame | None:
        """A table that is written whole at each tick; None empties it."""
        if df is None:
            self.staged[name] = []
            return None
        at, back = self._write(name, df)
        self.staged[name] = [{"path": at, "bits": 0, "schema": df.schema.jsonValue(), "rows": back.count()}]
        return back

    def get(self, name: str) -> DataFrame | None:
        """What put() kept."""
        runs = self.manifest["tables"].get(name) or []
        return self._run_rows(runs[0]) if runs else None

    def hold(self, name: str, df: DataFrame) -> DataFrame:
        """A table that several parts of a tick read; not part of the state."""
        return self._write(f"tick/{name}", df)[1]

    def output(self, df: DataFrame) -> DataFrame:
        at, written = self._write("output", df)
        self.staged["output"] = at
        return written

    def commit(self, version: int, position: dict[str, int] | None = None) -> None:
        """position: the files that this version and those before have read."""
        output = self.staged.pop("output", None)
        old = dict(self.manifest["tables"])
        self.manifest = {"version": version, "plan": self.plan_key, "layout": LAYOUT, "tables": old | self.staged, "output": output, "position": position or self.position}
        temporary = self._path(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        self._put(temporary, json.dumps(self.manifest))
        if not self._fs.rename(temporary, self._path(f"{self.path}/manifest-{version:012d}.json")):
            raise RuntimeError(f"version {version} exists already")
        self._fs.delete(self._path(f"{self.path}/tables/tick"), True)
        self._forget(version)

    def _forget(self, version: int) -> None:
        """Drops tables that neither this manifest nor one of the last `keep` names."""
        names = sorted(str(f.getPath().getName()) for f in self._fs.globStatus(self._path(f"{self.path}/manifest-*.json")))
        used = set()
        for n in names[-self.keep :]:
            stream = self._fs.open(self._path(f"{self.path}/{n}"))
            m = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()
            used |= {*(r["path"] for runs in m["tables"].values() for r in runs), m["output"]}
        for n in names[: -self.keep]:
            self._fs.delete(self._path(f"{self.path}/{n}"), False)
        for f in self._fs.globStatus(self._path(f"{self.path}/tables/*/*")) or []:
            at = f"{self.path}/tables/{f.getPath().getParent().getName()}/{f.getPath().getName()}"
            if f.isDirectory() and at not in used and not at.endswith(self._run):
                self._fs.delete(f.getPath(), True)

    def last_output(self) -> DataFrame | None:
        at = self.manifest["output"]
        return self.spark.read.parquet(at) if at else None
