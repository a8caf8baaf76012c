import json
import threading
import urllib.error
import urllib.request

import pytest
import yaml

from rillflow import sinks
from rillflow.functions.zset import WEIGHT, consolidate, union
from rillflow.operators.join import ExpiringJoin
from rillflow.plans import nodes as N
from rillflow.plans.contract import by_contract
from rillflow.plans.sql import Unsupported, plan
from rillflow.session import cut
from rillflow.sources import ChainSource, CsvSource
from rillflow.sources.http import HttpSource, IngestLog
from rillflow.streaming import dml
from rillflow.streaming.pipeline import Config, Pipeline, sink_of
from rillflow.streaming.watermark import LATE, WatermarkConfig, WatermarkWindow, classify


def bag(df):
    names = [c for c in df.columns if c != WEIGHT]
    return sorted((tuple(r)[:-1], r[WEIGHT]) for r in consolidate(df).select(*names, WEIGHT).collect())


def csv(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


class Kept:
    def __init__(self):
        self.out = []

    def write(self, batch):
        self.out.append(cut(batch))

    def close(self):
        pass


# SQL front end


@pytest.mark.parametrize(
    "text",
    ["select a from t union select b from u", "select a from t, u", "select a + 1 from t", "select a, count(*) as n from t group by b", "insert into t values (1)", "select a from t join u on t.a > u.b", "select a from t join u on t.a = u.a join v on v.a = u.a", "select a from (select 1) x", "select sum(a) over (partition by b), lag(a) over (partition by c order by d) from t", "select a from t where (b", "select k from t group by k, tumble(ts)", "select k from t group by k, hop(ts, interval '0' second, interval '5' second)"],
)
def test_refused(text):
    with pytest.raises(ValueError):
        plan(text, {"t": ["a", "b"], "u": ["a", "b"]})


def test_hop_takes_the_slide_first():
    p = plan("select k, count(*) as n from t group by k, hop(ts, interval '5' second, interval '10' second)")
    w = p.input
    assert isinstance(w, N.TimeWindow) and (w.size, w.slide) == (10_000, 5_000)


def test_sources_and_scope():
    p = plan("select x.k as k, sum(y.v) as s from a x join b y on y.id = x.id where x.k <> 'a.b' group by x.k", {"a": ["id", "k"], "b": ["id", "v"]})
    assert p.sources() == ["a", "b"]


def test_dml_parse():
    s = dml.parse("insert into sales values ('10:00', 1000, 'A'), ('it''s; (x, y)', -2.5, null)")
    assert s.columns == ("col0", "col1", "col2") and len(s.rows) == 2
    assert dml.parse("update t set a = 'where', b = 2 where c = 'x'").predicate == "c = 'x'"
    assert dml.statements("a ';' b; c") == ["a ';' b", "c"]
    for bad in ("insert into t select 1", "insert into t values (f(1))", "insert into t (a) values (1, 2)", "merge t", "delete from t limit 1", "update t set a"):
        with pytest.raises(Unsupported):
            dml.parse(bad)


# Joins with expiry, watermarks


def test_join_expiry(spark):
    rows = lambda *x: spark.createDataFrame([(*r, 1) for r in x], "key long, v string, __count long")
    j = ExpiringJoin((("key", "key"),), 1000)
    none = rows().limit(0) if False else spark.createDataFrame([], "key long, v string, __count long")
    assert bag(j.tick(rows((1, "l")), rows((1, "r")), 0)) == [((1, "l", "r"), 1)]
    assert bag(j.tick(none, none, 500)) == []
    assert bag(j.tick(none, none, 2000)) == [((1, "l", "r"), -1)]
    assert bag(j.tick(rows((1, "l")), none, 2100)) == []  # its partner is gone


def test_join_expiry_is_renewed(spark):
    rows = lambda *x: spark.createDataFrame([(*r, 1) for r in x], "key long, v string, __count long")
    none = spark.createDataFrame([], "key long, v string, __count long")
    j = ExpiringJoin((("key", "key"),), 1000)
    j.tick(rows((1, "l")), rows((1, "r")), 0)
    assert bag(j.tick(rows((1, "l")), rows((1, "r")), 900)) == [((1, "l", "r"), 3)]
    assert bag(j.tick(none, none, 1500)) == []
    assert bag(j.tick(none, none, 1900)) == [((1, "l", "r"), -4)]


def test_classify(spark):
    rows = [(0, 5000), (1, 8000), (2, 2000), (3, 10_000), (4, 7999), (5, None), (6, 8000), (7, 4000)]
    df = spark.createDataFrame(rows, "seq long, ts long")
    got = {r["seq"]: r["__class"] for r in classify(df, "seq", "ts", 2000, 3500).collect()}
    assert got == {0: "ontime", 1: "ontime", 2: "dropped" if 2000 < 8000 - 2000 - 3500 else "late", 3: "ontime", 4: "late", 5: "dropped", 6: "ontime", 7: "dropped" if 4000 < 10_000 - 5500 else "late"}
    carried = {r["seq"]: r["__class"] for r in classify(df, "seq", "ts", 0, 0, 9000).collect()}
    assert carried[3] == "ontime" and carried[1] == "dropped"


@pytest.mark.parametrize("policy", ["drop", "emit", "buffer"])
def test_late_policies(spark, policy):
    node = N.TimeWindow(N.Scan("e"), "tumble", "ts", 10_000, 10_000, (), (N.Agg("count", "*", "n"),))
    w = WatermarkWindow(node, WatermarkConfig(True, 0, 9000, policy))
    batch = lambda *x: spark.createDataFrame(list(enumerate(x)), "__seq long, ts long")
    w.tick(batch(10_000))
    out = w.tick(batch(2000, 500))  # late, and beyond the lateness
    late = [r for r in out.where(LATE).collect()]
    assert [r["n"] for r in late] == ([1] if policy == "emit" else [])
    if policy == "buffer":
        assert [r["n"] for r in w.reprocess_late().collect()] == [1]
        assert w.reprocess_late() is None
    w.tick(batch(60_000))
    assert w.rows.count() == 1  # windows that nothing can reach are forgotten


# Sources, sinks, pipelines


def test_csv_source(spark, tmp_path):
    p = csv(tmp_path, "a.csv", "k,v,__count\na,1,1\nb,,2\na,1,-1\n")
    b = next(CsvSource(spark, p, {"v": "int"}).batches())
    assert bag(b) == [(("b", None), 2)]
    bad = csv(tmp_path, "b.csv", "k,v\na,x\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        next(CsvSource(spark, bad, {"v": "int"}).batches()).collect()
    with pytest.raises(ValueError):
        CsvSource(spark, p, {"v": "decimal"})
    c = ChainSource([CsvSource(spark, bad, {"v": "int"}), CsvSource(spark, p, {"v": "int"})], "skip")
    assert len(list(c.batches())) == 1 and len(c.errors) == 1


def post(port, body, path="/ingest"):
    req = urllib.request.Request(f"http://127.0.0.1:{port}{path}", data=body.encode(), method="POST")
    try:
        return urllib.request.urlopen(req, timeout=10).status
    except urllib.error.HTTPError as e:
        return e.code


def test_http_source(spark):
    s = HttpSource(spark, {"k": "string", "v": "int"}, port=0, batch_size=2, delay_ms=50)
    assert post(s.port, json.dumps([{"k": "a", "v": 1}, {"k": "b"}, {"k": "c", "v": 2.0, "__count": -1}])) == 202
    assert [post(s.port, x) for x in ("{", json.dumps({"v": "x"}), json.dumps({"v": 1.5}))] == [400, 400, 400]
    assert post(s.port, "[]", "/other") == 404
    assert urllib.request.urlopen.__name__ and post(s.port, json.dumps({"k": "d", "v": 4})) == 202
    threading.Timer(1.0, s.close).start()
    batches = [bag(b) for b in s.batches()]
    assert batches == [[(("a", 1), 1), (("b", None), 1)], [(("c", 2), -1), (("d", 4), 1)]]


def test_pipeline_goes_on_after_a_stop(spark, tmp_path):
    first = csv(tmp_path, "1.csv", "k,v\na,1\nb,5\n")
    second = csv(tmp_path, "2.csv", "k,v,__count\na,2,1\nb,5,-1\n")
    raw = {"source": {"type": "csv", "config": {"path": first, "schema": {"v": "int"}}}, "transform": {"type": "sql", "query": "select k, sum(v) as s from t group by k"}, "sink": {"type": "console"}, "state": {"path": str(tmp_path / "state")}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(raw))
    a, b = Kept(), Kept()
    assert Pipeline(spark, Config.read(str(tmp_path / "c.yaml")), a).run() == 1
    raw["source"]["config"]["path"] = second
    Pipeline(spark, Config.load(raw), b).run()
    assert bag(union(*a.out, *b.out)) == [(("a", 3), 1)]
    raw["source"] = {"type": "chain", "config": {"sources": [raw["source"]] * 2}}
    raw["state"] = {"path": str(tmp_path / "other")}
    c = Kept()
    raw["source"]["config"]["sources"] = [{"type": "csv", "config": {"path": first, "schema": {"v": "int"}}}] * 2
    assert Pipeline(spark, Config.load(raw), c).run() == 2
    assert bag(union(*c.out)) == [(("a", 2), 1), (("b", 10), 1)]


def test_pipeline_over_a_folder_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = {"source": {"type": "json_dir", "config": {"path": str(tmp_path / "in"), "schema": {"k": "string", "v": "int"}, "files": 1}}, "transform": {"query": "select k, count(*) as n from t group by k"}, "sink": {"type": "console"}, "state": {"path": str(tmp_path / "state")}}
    outs = []
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"k": "a", "v": i}) + "\n")
        sink = Kept()
        Pipeline(spark, Config.load(raw), sink).run()
        outs += sink.out
    assert bag(union(*outs)) == [(("a", 2), 1)]


def test_pipeline_of_a_join_with_ttl_and_of_a_watermark(spark, tmp_path):
    a = csv(tmp_path, "a.csv", "id,k\n1,x\n2,y\n")
    b = csv(tmp_path, "b.csv", "id,v\n1,10\n1,20\n")
    sources = {"a": {"type": "csv", "config": {"path": a, "schema": {"id": "int"}}}, "b": {"type": "csv", "config": {"path": b, "schema": {"id": "int", "v": "int"}}}}
    for more in ({}, {"join_ttl": "10s"}):
        raw = {"sources": sources, "transform": {"query": "select a.k as k, b.v as v from a join b on a.id = b.id where b.v > 10", **more}, "sink": {"type": "console"}, "state": {"path": str(tmp_path / f"s{len(more)}")}}
        sink = Kept()
        Pipeline(spark, Config.load(raw), sink).run()
        assert bag(union(*sink.out)) == [(("x", 20), 1)]
    e = csv(tmp_path, "e.csv", "ts,k\n10000,a\n2000,b\n11000,c\n")
    raw = {"source": {"type": "csv", "table": "e", "config": {"path": e, "schema": {"ts": "int"}}}, "transform": {"query": "select count(*) as n from e group by tumble(ts, interval '10' second)", "watermark": {"enabled": True, "policy": "drop"}}, "sink": {"type": "console"}}
    sink = Kept()
    Pipeline(spark, Config.load(raw), sink).run()
    assert [r["n"] for r in union(*sink.out).collect()] == [2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 2), ("b", 1, -1)], "z string, a long, __count long")
    lines = []
    sinks.ConsoleSink(out=lines.append).write(df)
    assert json.loads(lines[0])[0] == {"Tuple": {"z": "a", "a": None}, "Count": 2}
    sinks.JsonSink(str(tmp_path / "j")).write(df)
    assert spark.read.json(str(tmp_path / "j")).selectExpr("Tuple.z", "Count").orderBy("Count").collect()[0] == ("b", -1)
    s = sinks.CsvSink(str(tmp_path / "c"))
    s.write(df)
    s.write(df)
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.columns == ["a", "z", "__count"] and back.count() == 4 and back.where("a is null").count() == 2
    p = sinks.ParquetSink(str(tmp_path / "p"), "gzip", rotate_batches=2)
    p.write(df)
    assert not (tmp_path / "p").exists()
    p.write(df)
    p.write(df)
    p.close()
    assert spark.read.parquet(str(tmp_path / "p")).count() == 6
    with pytest.raises(ValueError):
        sinks.ParquetSink("x", "lzma")
    kept = Kept()
    now = [0.0]
    b = sinks.BatchingSink(kept, 3, 1000, clock=lambda: now[0])
    b.write(df)
    assert not kept.out
    b.write(df)
    assert kept.out[0].count() == 4
    b.write(df)
    now[0] = 2.0
    b.write(df.limit(0))
    assert len(kept.out) == 2
    b.close()
    cache = sinks.SchemaCache(spark, str(tmp_path / "schema.json"))
    assert cache.check("q", df.schema) == df.schema == cache.check("q", df.limit(0).select("z").schema)
    with pytest.raises(ValueError):
        cache.check("other", df.schema)


def test_csv_is_read_once_and_lost_output_is_sent_again(spark, tmp_path):
    path = csv(tmp_path, "1.csv", "k,v\na,1\nb,5\n")
    raw = {"source": {"type": "csv", "config": {"path": path, "schema": {"v": "int"}}}, "transform": {"type": "sql", "query": "select k, sum(v) as s from t group by k having sum(v) > 0"}, "sink": {"type": "console"}, "state": {"path": str(tmp_path / "state")}}
    first, again = Kept(), Kept()
    assert Pipeline(spark, Config.load(raw), first).run() == 1
    assert Pipeline(spark, Config.load(raw), again).run() == 0 and not again.out

    class Broken(Kept):
        def write(self, batch):
            raise OSError("the sink is away")

    raw["source"]["config"]["path"] = csv(tmp_path, "2.csv", "k,v\na,2\n")
    with pytest.raises(OSError):
        Pipeline(spark, Config.load(raw), Broken()).run()
    last = Kept()
    assert Pipeline(spark, Config.load(raw), last).run() == 0
    assert bag(union(*first.out, *last.out)) == [(("a", 3), 1), (("b", 5), 1)]


def test_late_rows_beyond_the_buffer_are_added(spark):
    from rillflow.plans import nodes as N
    from rillflow.streaming.watermark import WatermarkConfig, WatermarkWindow

    node = N.TimeWindow(N.Scan("t"), "tumble", "ts", 10, 10, (), (N.Agg("count", "*", "n"),))
    w = WatermarkWindow(node, WatermarkConfig(True, 0, 10**6, "buffer", 2))
    rows = spark.createDataFrame([(1, 100), (2, 5), (3, 6), (4, 7), (5, 100)], "__seq long, ts long")
    out = {(r["__window_start"], r["n"], r["__late"]) for r in w.tick(rows).where("__count > 0").collect()}
    assert out == {(100, 2, False), (0, 3, True)} and w.buffer is None


def test_sessions_that_nothing_can_reach_are_forgotten(spark):
    node = N.TimeWindow(N.Scan("t"), "session", "ts", 10, 10, (("k", "k"),), (N.Agg("count", "*", "n"),))
    w = WatermarkWindow(node, WatermarkConfig(True, 0, 15, "buffer"))
    batch = lambda *x: spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "__seq long, k string, ts long")
    w.tick(batch(("a", 0), ("a", 8), ("a", 30), ("b", 31)))
    assert sorted(r["ts"] for r in w.rows.collect()) == [8 - 8, 8, 30, 31]  # the first ended at 18, and 16 can still come
    w.tick(batch(("a", 18), ("b", 60)))  # 18 is late, waits, and joins the first session
    assert sorted(r["ts"] for r in w.rows.collect()) == [0, 8, 60]  # those of 30 and 31 ended before 45
    out = {(r["k"], r["__window_start"], r["n"], r[WEIGHT]) for r in w.reprocess_late().collect()}
    assert out == {("a", 0, 2, -1), ("a", 0, 3, 1)}


def test_rows_of_http_are_kept_until_they_are_read(spark, tmp_path):
    log = lambda: IngestLog(spark, str(tmp_path / "log"))
    s = HttpSource(spark, {"k": "string"}, port=0, batch_size=2, log=log())
    assert post(s.port, json.dumps([{"k": "a"}, {"k": "b"}, {"k": "c"}])) == 202 and post(s.port, json.dumps({"k": "d"})) == 202
    batches = s.batches()
    assert bag(next(batches)) == [(("a",), 1), (("b",), 1)]
    upto, origin = s.upto, s.origin
    s.close()
    again = HttpSource(spark, {"k": "string"}, port=0, batch_size=2, log=log())
    assert post(again.port, json.dumps({"k": "e"})) == 202
    threading.Timer(1.0, again.close).start()
    assert [bag(b) for b in again.batches({origin: upto})] == [[(("c",), 1)], [(("d",), 1)], [(("e",), 1)]]
    assert log().entries() == []
    last = HttpSource(spark, {"k": "string"}, port=0, log=log())
    assert last.next > again.upto
    last.close()


def test_http_pipeline_goes_on_after_a_stop(spark, tmp_path):
    raw = {"source": {"type": "http", "config": {"port": 0, "schema": {"k": "string", "v": "int"}, "max_batch_size": 2}}, "transform": {"query": "select k, sum(v) as s from t group by k"}, "sink": {"type": "console"}, "state": {"path": str(tmp_path / "state")}}

    class Broken(Kept):
        def write(self, batch):
            raise OSError("the sink is away")

    first = Pipeline(spark, Config.load(raw), Broken())
    assert post(first.sources["t"].port, json.dumps([{"k": "a", "v": 1}, {"k": "b", "v": 2}, {"k": "a", "v": 4}])) == 202
    with pytest.raises(OSError):  # the first batch is in the state, not in the sink; the second in the log alone
        first.run()
    kept = Kept()
    second = Pipeline(spark, Config.load(raw), kept)
    threading.Timer(6.0, second.stop).start()
    second.run()
    assert bag(union(*kept.out)) == [(("a", 5), 1), (("b", 2), 1)]


@pytest.mark.parametrize("policy", ["emit", "buffer"])
def test_watermark_is_known_after_a_restart(spark, tmp_path, policy):
    raw = {"source": {"type": "csv", "table": "e", "config": {"schema": {"ts": "int"}}}, "transform": {"query": "select k, count(*) as n from e group by k, tumble(ts, interval '10' second) having count(*) > 1", "watermark": {"enabled": True, "policy": policy, "allowed_lateness": 9000}}, "sink": {"type": "console"}, "state": {"path": str(tmp_path / "state")}}
    kept = Kept()
    for i, text in enumerate(["ts,k\n11000,a\n", "ts,k\n12000,a\n1000,a\n9500,a\n4000,a\n"]):
        raw["source"]["config"]["path"] = csv(tmp_path, f"{i}.csv", text)
        assert Pipeline(spark, Config.load(raw), kept).run() == 1
    assert Pipeline(spark, Config.load(raw), kept).run() == 0  # the same file
    # 1000 lies over 9 s behind 11000, which the first run saw
    got = [(r["k"], r["n"], r[LATE]) for r in union(*kept.out).where(f"{WEIGHT} > 0").collect()]
    assert sorted(got) == [("a", 2, False), ("a", 2, True)]
    raw["transform"]["query"] = "select count(*) as n from e group by tumble(ts, interval '10' second)"
    with pytest.raises(ValueError):
        Pipeline(spark, Config.load(raw), kept)


def test_watermark_over_a_folder_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = {"source": {"type": "json_dir", "config": {"path": str(tmp_path / "in"), "schema": {"ts": "int"}, "files": 1}}, "transform": {"query": "select count(*) as n from e group by tumble(ts, interval '10' second)", "watermark": {"enabled": True}}, "sink": {"type": "console"}, "state": {"path": str(tmp_path / "state")}}
    outs = []
    for i, rows in enumerate([[11000], [2000, 12000]]):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"ts": t}) + "\n" for t in rows))
        sink = Kept()
        Pipeline(spark, Config.load(raw), sink).run()
        outs += sink.out
    assert [x for x, c in bag(union(*outs)) if c > 0 and x[-1] is False] and sum(r["n"] * r[WEIGHT] for r in union(*outs).collect()) == 2


def test_rows_of_an_expiring_join_are_known_after_a_restart(spark, tmp_path):
    a = csv(tmp_path, "a.csv", "id,k\n1,x\n2,y\n")
    more = csv(tmp_path, "more.csv", "id,k\n1,z\n")
    b = csv(tmp_path, "b.csv", "id,v\n1,10\n")
    of = lambda p, **s: {"type": "csv", "config": {"path": p, "schema": {"id": "int", **s}}}
    raw = {"sources": {"a": of(a), "b": of(b, v="int")}, "transform": {"query": "select a.k as k, b.v as v from a join b on a.id = b.id", "join_ttl": "1h"}, "sink": {"type": "console"}, "state": {"path": str(tmp_path / "s")}}
    kept = Kept()
    assert Pipeline(spark, Config.load(raw), kept).run() == 2
    raw["sources"]["a"] = of(more)
    assert Pipeline(spark, Config.load(raw), kept).run() == 1
    assert bag(union(*kept.out)) == [(("x", 10), 1), (("z", 10), 1)]


def test_parquet_files_keep_the_first_schema(spark, tmp_path):
    of = lambda: sink_of({"type": "parquet", "config": {"path": str(tmp_path / "p"), "schema_cache": str(tmp_path / "schema.json")}}, spark, "q")
    of().write(spark.createDataFrame([(1, "a", 1)], "n long, k string, __count long"))
    of().write(spark.createDataFrame([("b", 2, 1)], "k string, n int, __count long"))
    assert [f.name for f in spark.read.parquet(str(tmp_path / "p")).schema] == ["n", "k", WEIGHT]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).collect())) == [(1, "a", 1), (2, "b", 1)]


def test_names_of_the_delta_contract(spark, tmp_path):
    def ticks(query, schema, *texts):
        path = tmp_path / str(len(list(tmp_path.iterdir())))
        path.mkdir()
        out = []
        for i, text in enumerate(texts):
            raw = {"source": {"type": "csv", "table": "t", "config": {"path": csv(path, f"{i}.csv", text), "schema": schema}}, "transform": {"query": query, "names": "contract"}, "sink": {"type": "console"}, "state": {"path": str(path / "state")}}
            sink = Kept()
            Pipeline(spark, Config.load(raw), sink).run()
            out.append(sorted(sink.out[0].collect()))
        return out

    got = ticks("select k, sum(v) as s, count(id) as n from t group by k", {"v": "float", "id": "int"}, "k,v,id,__count\nA,10,1,1\n", "k,v,id,__count\nA,10,1,-1\n")
    assert [[r.asDict() for r in t] for t in got] == [[{"k": "A", "agg_delta": 10.0, "count_delta": 1, WEIGHT: 1}], [{"k": "A", "agg_delta": -10.0, "count_delta": -1, WEIGHT: 1}]]
    got = ticks("select k, min(v) as lo, max(v) as hi, avg(v) as a, sum(v) as s, sum(v * 2) as d from t group by k", {"v": "int"}, "k,v,__count\nA,30,1\nA,10,1\nA,20,1\nB,5,1\nC,,1\n", "k,v,__count\nA,10,-1\nB,5,-1\nC,,1\n")
    names = ["k", "min", "max", "avg_delta", "agg_delta", "agg_delta_d"]
    assert [[tuple(r[n] for n in names) for r in t] for t in got] == [
        [("A", 10, 30, 20.0, 60.0, 120.0), ("B", 5, 5, 5.0, 5.0, 10.0)],  # C has no value
        [("A", 20, 30, 5.0, -10.0, -20.0), ("B", None, None, -5.0, -5.0, -10.0)],
    ]
    got = ticks("select count(*) as n from t", {"v": "int"}, "v\n1\n2\n", "v,__count\n1,-1\n")
    assert [[tuple(r) for r in t] for t in got] == [[(2, 1)], [(-1, 1)]]
    got = ticks("select k, v, sum(v) over (partition by k order by v) as r from t", {"v": "int"}, "k,v\na,1\na,2\n")
    assert [(r["v"], r["agg_result"]) for r in got[0]] == [(1, 1), (2, 3)]
    for bad in ("select k, sum(v) + 1 as s from t group by k", "select k from t"):
        with pytest.raises(ValueError):
            by_contract(plan(bad, {"t": ["k", "v"]}))


def test_rows_of_sessions_are_taken_back(spark):
    node = N.TimeWindow(N.Scan("t"), "session", "ts", 10, 10, (("k", "k"),), (N.Agg("count", "*", "n"),))
    w = WatermarkWindow(node, WatermarkConfig(True, 100, 0, "drop"))
    batch = lambda *x: spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "__seq long, k string, ts long, __count long")
    got = lambda df: {(r["k"], r["__window_start"], r["__window_end"], r["n"], r[WEIGHT]) for r in df.collect()}
    assert got(w.tick(batch(("a", 0, 1), ("a", 8, 1), ("b", 3, 1)))) == {("a", 0, 18, 2, 1), ("b", 3, 13, 1, 1)}
    assert got(w.tick(batch(("a", 8, -1), ("b", 3, -1)))) == {("a", 0, 18, 2, -1), ("a", 0, 10, 1, 1), ("b", 3, 13, 1, -1)}
    assert got(w.tick(batch(("c", 5, 1)))) == {("c", 5, 15, 1, 1)}
    assert w.rows.count() == 2
