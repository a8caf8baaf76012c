"""The registered queries and the SQL that each of them equals.

Most texts run through this library's front end and, unchanged, in DuckDB; where
the two need other words (time windows, epochs), the pair says so.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.zset import WEIGHT, expand, negate, union
from rillflow.operators.timewindow import END, START
from rillflow.plans import nodes as N
from rillflow.plans.sql import plan as parse
from rillflow.plans.sql import view_sql
from rillflow.plans.view import view
from rillflow.session import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Tables(dict):
    """Tables of a folder, read when they are asked for. events has its time in
    milliseconds as ms."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "events":
            df = df.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
        self[name] = df
        return df


EVENTS = "(select *, epoch_us(ts) // 1000 as ms from events) events"

#: SQL that both sides read: plain queries, and view queries of the front end.
SAME: dict[str, tuple[tuple[str, ...], str]] = {
    "sum_group": (("orders",), "select o_orderstatus, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by o_orderstatus"),
    "project_filter": (("orders",), "select o_orderkey, o_totalprice from orders where o_totalprice > 200000 and o_orderstatus = 'F'"),
    "pred_and_or_paren": (("orders",), "select o_orderkey as k from orders where (o_orderstatus = 'F' or o_orderstatus = 'O') and (o_totalprice < 50000 or o_totalprice >= 300000)"),
    "pred_null": (("customer",), "select c_custkey, v from (select c_custkey, nullif(c_mktsegment, 'BUILDING') as v from customer) t where v is null or v is not null and c_custkey <= 50"),
    "pred_neq": (("orders",), "select o_orderkey as k, o_orderstatus as s from orders where o_orderstatus != 'O' and o_orderstatus <> 'P'"),
    "expr_arith": (("lineitem",), "select l_orderkey, l_linenumber, round((l_extendedprice + 10) * (1 - l_discount) / 2 - -l_tax, 6) as v from lineitem"),
    "expr_cast": (("lineitem",), "select l_orderkey, l_linenumber, cast(l_linenumber as double) as d, cast(floor(l_quantity) as bigint) as i, cast(l_orderkey as varchar(20)) as s from lineitem"),
    "expr_case": (("orders",), "select o_orderkey, case when o_totalprice > 100000 then 'big' when o_totalprice > 50000 then 'mid' else 'small' end as size from orders"),
    "count_star_group": (("lineitem",), "select l_returnflag, count(*) as n from lineitem group by l_returnflag"),
    "count_col_group": (("customer",), "select c_nationkey, count(v) as n from (select c_nationkey, nullif(c_mktsegment, 'BUILDING') as v from customer) t group by c_nationkey"),
    "avg_group": (("orders",), "select o_orderpriority, round(avg(o_totalprice), 4) as mean from orders group by o_orderpriority"),
    "min_group": (("lineitem",), "select l_returnflag, min(l_extendedprice) as low from lineitem group by l_returnflag"),
    "max_group": (("lineitem",), "select l_shipmode_key, max(l_extendedprice) as high from (select l_linenumber as l_shipmode_key, l_extendedprice from lineitem) t group by l_shipmode_key"),
    "multi_agg": (("lineitem",), "select l_returnflag, cast(sum(cast(l_quantity as decimal(18,2))) as double) as q, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as p, count(*) as n, min(l_tax) as low, max(l_tax) as high from lineitem group by l_returnflag"),
    "multi_key_group": (("lineitem",), "select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as q from lineitem group by l_returnflag, l_linestatus"),
    "filter_agg": (("lineitem",), "select l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as q from lineitem where l_quantity > 25 and l_discount < 0.05 group by l_linestatus"),
    "join_project": (("customer", "orders"), "select c.c_name as name, o.o_orderkey as k from customer c join orders o on c.c_custkey = o.o_custkey"),
    "join_multi_cond": (("supplier", "customer"), "select s.s_suppkey as s, c.c_custkey as c from supplier s join customer c on s.s_nationkey = c.c_nationkey and s.s_suppkey = c.c_custkey"),
    "join_filter_project": (("customer", "orders"), "select c.c_custkey as c, o.o_totalprice as p from customer c join orders o on c.c_custkey = o.o_custkey where o.o_totalprice > 100000 and c.c_acctbal < 0"),
    "join_group_sum": (("customer", "orders"), "select c.c_nationkey as nation, cast(sum(cast(o.o_totalprice as decimal(18,2))) as double) as total from customer c join orders o on c.c_custkey = o.o_custkey group by c.c_nationkey"),
    "join_filter_group_multi": (("customer", "orders"), "select c.c_mktsegment as seg, count(*) as n, cast(sum(cast(o.o_totalprice as decimal(18,2))) as double) as total from customer c join orders o on c.c_custkey = o.o_custkey where o.o_orderstatus = 'F' group by c.c_mktsegment"),
    "join_left": (("customer", "orders"), "select c.c_custkey as c, count(o.o_orderkey) as n from customer c left join orders o on c.c_custkey = o.o_custkey group by c.c_custkey"),
    "having": (("orders",), "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15"),
    "distinct": (("orders",), "select distinct o_orderstatus, o_orderpriority from orders"),
    "count_distinct": (("orders",), "select o_orderstatus, count(distinct o_custkey) as n from orders group by o_orderstatus"),
    "global_agg": (("orders",), "select count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, min(o_totalprice) as low, max(o_totalprice) as high from orders"),
    "lag_1": (("orders",), "select o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as prev from orders"),
    "lag_n": (("orders",), "select o_orderkey, lag(o_totalprice, 2) over (partition by o_custkey order by o_orderkey) as prev from orders"),
    "lag_no_partition": (("nation",), "select n_nationkey, lag(n_name) over (order by n_nationkey) as prev from nation"),
    "over_running_sum": (("orders",), "select o_orderkey, cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderkey) as double) as run from orders"),
    "over_total": (("orders",), "select o_orderkey, count(*) over (partition by o_custkey) as n, max(o_totalprice) over (partition by o_custkey) as top from orders"),
    "frame_rows": (("orders",), "select o_orderkey, cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderkey rows between 2 preceding and 1 following) as double) as s from orders"),
    "frame_range": (("lineitem",), "select l_orderkey, l_linenumber, cast(sum(cast(l_quantity as decimal(18,2))) over (partition by l_orderkey order by l_linenumber range between 1 preceding and current row) as double) as s from lineitem"),
    "rank_functions": (("orders",), "select o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as rn, cast(rank() over (partition by o_custkey order by o_orderpriority) as bigint) as r, cast(dense_rank() over (partition by o_custkey order by o_orderpriority) as bigint) as d, cast(ntile(4) over (partition by o_custkey order by o_orderkey) as bigint) as q from orders"),
    "rank_shares": (("orders",), "select o_orderkey, round(percent_rank() over (partition by o_custkey order by o_totalprice), 9) as p, round(cume_dist() over (partition by o_custkey order by o_totalprice), 9) as c from orders"),
    "lead_first_last_nth": (("orders",), "select o_orderkey, lead(o_totalprice) over (partition by o_custkey order by o_orderkey) as nxt, first_value(o_totalprice) over (partition by o_custkey order by o_orderkey) as f, last_value(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) as l, nth_value(o_totalprice, 2) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) as n2 from orders"),
    "sort_limit_offset": (("orders",), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 10"),
    "topk": (("orders",), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25"),
}

MONEY = "cast(value as decimal(18,2))"
Q = "__window_start, __window_end"
_TUMBLE = f"select event_type, {{}}, ms - ms % 3600000 as __window_start, ms - ms % 3600000 + 3600000 as __window_end from {EVENTS} {{}} group by all"
_HOP = f"select event_type, {{}}, s as __window_start, s + 7200000 as __window_end from (select *, unnest(generate_series(((ms - 7200000) // 1800000 + 1) * 1800000, ms // 1800000 * 1800000, 1800000)) as s from {EVENTS}) where s >= 0 group by all"
_SESSION = f"""select user_id, {{}}, min(ms) as __window_start, max(ms) + 1800000 as __window_end from (select *, sum(brk) over (partition by user_id order by ms range unbounded preceding) as sid
    from (select *, case when ms - lag(ms) over (partition by user_id order by ms) <= 1800000 then 0 else 1 end as brk from {EVENTS})) group by user_id, sid"""

#: (tables, query of the front end, DuckDB SQL)
PAIRS: dict[str, tuple[tuple[str, ...], str, str]] = {
    **{
        f"tumble_{name}": (("events",), f"select event_type, {ours} from events group by event_type, tumble(ms, interval '1' hour)", _TUMBLE.format(theirs, ""))
        for name, ours, theirs in (
            ("sum", f"sum({MONEY}) as v", f"sum({MONEY})::decimal(28,2) as v"),
            ("count", "count(*) as v", "count(*) as v"),
            ("min", "min(value) as v", "min(value) as v"),
            ("max", "max(value) as v", "max(value) as v"),
        )
    },
    "tumble_filter": (("events",), f"select event_type, sum({MONEY}) as v, count(*) as n from events where value > 50 and event_type != 'click' group by event_type, tumble(ms, interval '1' hour)", _TUMBLE.format(f"sum({MONEY})::decimal(28,2) as v, count(*) as n", "where value > 50 and event_type != 'click'")),
    "hop_sum": (("events",), f"select event_type, sum({MONEY}) as v from events group by event_type, hop(ms, interval '30' minute, interval '2' hour)", _HOP.format(f"sum({MONEY})::decimal(28,2) as v")),
    "hop_count": (("events",), "select event_type, count(*) as v from events group by event_type, sliding(ms, interval '30' minute, interval '2' hour)", _HOP.format("count(*) as v")),
    "session_count": (("events",), "select user_id, count(*) as v from events group by user_id, session(ms, interval '30' minute)", _SESSION.format("count(*) as v")),
    "session_sum": (("events",), f"select user_id, sum({MONEY}) as v from events group by user_id, session(ms, interval '30' minute)", _SESSION.format(f"sum({MONEY})::decimal(28,2) as v")),
    "tumble_join": (("events", "customer"), "select c.c_mktsegment as seg, count(*) as v from events e join customer c on e.user_id = c.c_custkey group by c.c_mktsegment, tumble(e.ms, interval '1' day)", f"select c_mktsegment as seg, count(*) as v, ms - ms % 86400000 as __window_start, ms - ms % 86400000 + 86400000 as __window_end from {EVENTS} join customer on user_id = c_custkey group by all"),
    "frame_groups": (("orders",), f"select o_orderkey, sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderpriority groups between 1 preceding and current row) as v from orders", "select o_orderkey, sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey order by o_orderpriority groups between 1 preceding and current row)::decimal(28,2) as v from orders"),
    "frame_range_interval": (("events",), f"select event_id, sum({MONEY}) over (partition by user_id order by ms range between interval '1' hour preceding and current row) as v from events", f"select event_id, sum({MONEY}) over (partition by user_id order by ms range between 3600000 preceding and current row)::decimal(28,2) as v from {EVENTS}"),
}


def _text(tables: tuple[str, ...], text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return view_sql(spark, text, {n: t[n] for n in tables})

    return run


def _as_double(run, *names: str):
    def cast(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.withColumns({n: F.col(n).cast("double") for n in names if n in df.columns and dict(df.dtypes)[n].startswith("decimal")})

    return cast


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    plan = N.Union(N.Project(N.Scan("customer"), (("c_nationkey", "nation"),)), N.Project(N.Scan("supplier"), (("s_nationkey", "nation"),)))
    return view(plan, {n: t[n] for n in ("customer", "supplier")})


def zset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    plan = N.Difference(N.Project(N.Scan("customer"), (("c_nationkey", "nation"),)), N.Project(N.Scan("supplier"), (("s_nationkey", "nation"),)))
    return view(plan, {n: t[n] for n in ("customer", "supplier")}, keep_weight=True)


def topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = N.TopK(N.Project(N.Scan("orders"), (("o_custkey", "c"), ("o_orderkey", "k"), ("o_totalprice", "p"))), 3, ("p desc", "k"), ("c",))
    return view(plan, {"orders": Tables(spark, sf_dir)["orders"]})


def late_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events are on time, late or dropped, in the order of event_id."""
    from rillflow.streaming.watermark import CLASS, classify

    e = Tables(spark, sf_dir)["events"].select("event_id", "ms")
    e = e.withColumn("ms", F.when(F.col("event_id") % 10 == 0, F.col("ms") - 7_200_000).when(F.col("event_id") % 15 == 0, F.col("ms") - 90_000_000).otherwise(F.col("ms")))
    return classify(e, "event_id", "ms", 3_600_000, 86_400_000).groupBy(F.col(CLASS).alias("class")).agg(F.count("*").alias("n"))


def _late(policy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Hourly counts after two batches under a late policy; late rows that were
        taken are marked."""
        from rillflow.streaming.watermark import LATE, WatermarkConfig, WatermarkWindow

        e = Tables(spark, sf_dir)["events"].select("event_id", F.when(F.col("event_id") % 10 == 0, F.col("ms") - 7_200_000).otherwise(F.col("ms")).alias("ms"), F.col("event_id").alias("__seq"))
        node = N.TimeWindow(N.Scan("events"), "tumble", "ms", 86_400_000, 86_400_000, (), (N.Agg("count", "*", "n"),))
        w = WatermarkWindow(node, WatermarkConfig(True, 0, 86_400_000, policy))
        # every second event of a batch is a row; the watermark is carried over
        half = e.agg(F.expr("cast(max(event_id) / 2 as bigint)")).first()[0]
        out = union(w.tick(e.where(F.col("event_id") <= half)), w.tick(e.where(F.col("event_id") > half)))
        grouped = out.groupBy(START, LATE).agg(F.sum(F.col("n") * F.col(WEIGHT)).alias("n"))
        return grouped.where("n <> 0").select(F.col(START).alias("day"), F.col(LATE).alias("late"), "n")

    return run


LATE_ROWS = """with e as (select event_id, case when event_id % 10 = 0 then epoch_us(ts) // 1000 - 7200000 else epoch_us(ts) // 1000 end as ms from events),
c as (select *, max(ms) over (order by event_id) as top from e)
select ms - ms % 86400000 as day, ms < top as late, count(*) as n from c where {} group by all"""


def dml_update_delete_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table changed by UPDATE and DELETE statements, then aggregated."""
    from rillflow.streaming import dml

    t = cut(Tables(spark, sf_dir)["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice").withColumn(WEIGHT, F.lit(1).cast("long")))
    for s in ("update orders set o_orderstatus = 'X', o_totalprice = 1 where o_orderkey % 7 = 0", "delete from orders where o_totalprice > 300000 or o_orderkey % 11 = 3"):
        t = cut(union(t, dml.delta(spark, dml.parse(s), t)).groupBy("o_orderkey", "o_orderstatus", "o_totalprice").agg(F.sum(WEIGHT).alias(WEIGHT)).where("__count <> 0"))
    p = parse("select o_orderstatus, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as total from orders group by o_orderstatus")
    return view(p, {"orders": t}).withColumn("total", F.col("total").cast("double"))


def _incremental(query: str, tables: dict[str, tuple[str, ...]], key: str, gone: str, first: str):
    """Replays a table's rows in two inserting ticks and one that takes some away
    again; returns the sum of the result's deltas."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from rillflow.session import cut as named
        from rillflow.streaming.engine import IncrementalQuery

        t = Tables(spark, sf_dir)
        data = {n: t[n].select(*c).withColumn(WEIGHT, F.lit(1).cast("long")) for n, c in tables.items()}
        named(spark.range(1))
        path = os.path.join(spark.sparkContext.getCheckpointDir(), f"ivm-{uuid.uuid4().hex}")
        q = IncrementalQuery(spark, query, {n: d.schema for n, d in data.items()}, path)
        main = data[first]
        others = {n: d for n, d in data.items() if n != first}
        outs = [
            cut(q.tick({first: main.where(f"{key} % 3 = 0"), **{n: d.where(f"{d.columns[0]} % 2 = 0") for n, d in others.items()}})),
            cut(q.tick({first: main.where(f"{key} % 3 <> 0"), **{n: d.where(f"{d.columns[0]} % 2 <> 0") for n, d in others.items()}})),
            cut(q.tick({first: negate(main.where(gone))})),
        ]
        out = union(*outs)
        names = [c for c in out.columns if c != WEIGHT]
        total = out.groupBy(*names).agg(F.sum(WEIGHT).alias(WEIGHT)).where("__count <> 0")
        return expand(total).drop(WEIGHT)

    return run


INCREMENTAL = {
    "ivm_groupagg_delta_sum": (
        _incremental("select o_orderstatus, sum(p) as total, count(*) as n, max(p) as high from orders group by o_orderstatus".replace("p)", "o_totalprice)"), {"orders": ("o_orderkey", "o_orderstatus", "o_totalprice")}, "o_orderkey", "o_orderkey % 7 = 0", "orders"),
        "select o_orderstatus, round(sum(o_totalprice), 2) as total, count(*) as n, max(o_totalprice) as high from orders where o_orderkey % 7 <> 0 group by o_orderstatus",
    ),
    "ivm_linear_delta_sum": (
        _incremental("select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as total, count(*) as n from orders group by o_custkey", {"orders": ("o_orderkey", "o_custkey", "o_totalprice")}, "o_orderkey", "o_orderkey % 7 = 0", "orders"),
        "select o_custkey, sum(cast(o_totalprice as decimal(18,2)))::double as total, count(*) as n from orders where o_orderkey % 7 <> 0 group by o_custkey",
    ),
    "ivm_join_delta_sum": (
        _incremental("select c.c_nationkey as nation, sum(cast(o.o_totalprice as decimal(18,2))) as total, count(*) as n from orders o join customer c on o.o_custkey = c.c_custkey group by c.c_nationkey", {"orders": ("o_orderkey", "o_custkey", "o_totalprice"), "customer": ("c_custkey", "c_nationkey")}, "o_orderkey", "o_orderkey % 7 = 0", "orders"),
        "select c_nationkey as nation, sum(cast(o_totalprice as decimal(18,2)))::double as total, count(*) as n from orders join customer on o_custkey = c_custkey where o_orderkey % 7 <> 0 group by c_nationkey",
    ),
    "ivm_session_delta_sum": (
        _incremental("select user_id, count(*) as v from events group by user_id, session(ms, interval '30' minute)", {"events": ("event_id", "user_id", "ms")}, "event_id", "event_id % 7 = 0", "events"),
        _SESSION.format("count(*) as v").replace("from events)", "from events where event_id % 7 <> 0)"),
    ),
    "ivm_lag_delta_sum": (
        _incremental("select o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as prev from orders", {"orders": ("o_orderkey", "o_custkey", "o_totalprice")}, "o_orderkey", "o_orderkey % 7 = 0", "orders"),
        "select o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as prev from orders where o_orderkey % 7 <> 0",
    ),
    "ivm_avg_delta": (
        _incremental("select o_orderstatus, round(avg(o_custkey), 6) as mean from orders group by o_orderstatus", {"orders": ("o_orderkey", "o_custkey", "o_orderstatus")}, "o_orderkey", "o_orderkey % 7 = 0", "orders"),
        "select o_orderstatus, round(avg(o_custkey), 6) as mean from orders where o_orderkey % 7 <> 0 group by o_orderstatus",
    ),
    "ivm_frame_delta": (
        _incremental("select o_orderkey, sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) as s from orders", {"orders": ("o_orderkey", "o_custkey")}, "o_orderkey", "o_orderkey % 7 = 0", "orders"),
        "select o_orderkey, (sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row))::bigint as s from orders where o_orderkey % 7 <> 0",
    ),
    "ivm_distinct_delta": (
        _incremental("select distinct o_custkey, o_orderstatus from orders", {"orders": ("o_orderkey", "o_custkey", "o_orderstatus")}, "o_orderkey", "o_orderkey % 7 = 0", "orders"),
        "select distinct o_custkey, o_orderstatus from orders where o_orderkey % 7 <> 0",
    ),
    "ivm_left_join_delta": (
        _incremental("select c.c_custkey as c, o.o_orderkey as o from customer c left join orders o on c.c_custkey = o.o_custkey", {"orders": ("o_orderkey", "o_custkey"), "customer": ("c_custkey",)}, "o_orderkey", "o_orderkey % 7 = 0", "orders"),
        "select c_custkey as c, o_orderkey as o from customer left join (select * from orders where o_orderkey % 7 <> 0) on c_custkey = o_custkey",
    ),
}

OTHERS: dict[str, tuple[Callable, str]] = {
    "union_all": (union_all, "select c_nationkey as nation from customer union all select s_nationkey from supplier"),
    "zset_difference": (zset_difference, "select nation, sum(w)::bigint as __count from (select c_nationkey as nation, 1 as w from customer union all select s_nationkey, -1 from supplier) group by nation having sum(w) <> 0"),
    "topk_per_key": (topk_per_key, "select o_custkey as c, o_orderkey as k, o_totalprice as p from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3"),
    "late_classes": (
        late_classes,
        """with e as (select event_id, case when event_id % 10 = 0 then epoch_us(ts) // 1000 - 7200000 when event_id % 15 = 0 then epoch_us(ts) // 1000 - 90000000 else epoch_us(ts) // 1000 end as ms from events),
w as (select ms, max(ms) over (order by event_id) - 3600000 as mark from e)
select case when ms < mark - 86400000 then 'dropped' when ms < mark then 'late' else 'ontime' end as class, count(*) as n from w group by all""",
    ),
    "late_drop": (_late("drop"), LATE_ROWS.format("ms >= top")),
    "late_emit": (_late("emit"), LATE_ROWS.format("ms >= top - 86400000")),
    "dml_update_delete_view": (
        dml_update_delete_view,
        """with u as (select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 7 = 0 then 1 else o_totalprice end as o_totalprice from orders)
select o_orderstatus, count(*) as n, sum(cast(o_totalprice as decimal(18,2)))::double as total from u where not (o_totalprice > 300000 or o_orderkey % 11 = 3) group by o_orderstatus""",
    ),
}


def _rounded(run, name: str):
    return lambda spark, sf_dir: run(spark, sf_dir).withColumn(name, F.round(F.col(name), 2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: _text(tables, text) for n, (tables, text) in SAME.items()}
    out |= {n: _as_double(_text(tables, text), "v") for n, (tables, text, _) in PAIRS.items()}
    out |= {n: f for n, (f, _) in OTHERS.items()}
    out |= {n: _as_double(f, "total") for n, (f, _) in INCREMENTAL.items()}
    out["ivm_groupagg_delta_sum"] = _rounded(out["ivm_groupagg_delta_sum"], "total")
    return out


def oracle_sql() -> dict[str, str]:
    out = {n: text for n, (_, text) in SAME.items()}
    out |= {n: theirs.replace("::decimal(28,2)", "::double") for n, (_, _, theirs) in PAIRS.items()}
    out |= {n: text for n, (_, text) in OTHERS.items()}
    return out | {n: text for n, (_, text) in INCREMENTAL.items()}
