import pytest
from pyspark.sql import functions as F

from rillflow.functions import intervals, tolerant, zset


@pytest.mark.parametrize("text, ms", [("10 seconds", 10_000), ("INTERVAL '5' MINUTE", 300_000), ("1 hr", 3_600_000), ("2 days", 172_800_000), ("7 ms", 7), ("1h30m", 5_400_000), ("10s", 10_000), ("interval '2 hours'", 7_200_000)])
def test_interval(text, ms):
    assert intervals.interval_ms(text) == ms


@pytest.mark.parametrize("text", ["", "ten seconds", "10", "10 fortnights", "5 seconds ago"])
def test_no_interval(text):
    with pytest.raises(ValueError):
        intervals.interval_ms(text)


def bag(df):
    return {tuple(r)[:-1]: r["__count"] for r in df.select(*zset.columns(df), "__count").collect()}


def test_zset(spark):
    a = spark.createDataFrame([("x", 1, 2), ("x", 1, 1), ("y", 2, 1), ("z", None, 1), ("z", None, -1)], "k string, v int, __count long")
    b = spark.createDataFrame([("x", 1, 1), ("w", 5, 1)], "k string, v int, __count long")
    assert bag(zset.consolidate(a)) == {("x", 1): 3, ("y", 2): 1}
    assert bag(zset.difference(a, b)) == {("x", 1): 2, ("y", 2): 1, ("w", 5): -1}
    assert bag(zset.distinct(a)) == {("x", 1): 1, ("y", 2): 1}
    assert zset.expand(a).count() == 5  # before consolidation a row counts as it stands
    assert bag(zset.consolidate(zset.union(a, zset.negate(a)))) == {}
    with pytest.raises(zset.Underflow):
        zset.check(zset.integrate(b, zset.negate(zset.consolidate(a))))


def test_delete_before_insert_in_one_delta(spark):
    d = spark.createDataFrame([("x", -1), ("x", 1)], "k string, __count long")
    assert bag(zset.check(zset.integrate(None, d))) == {}


@pytest.mark.parametrize(
    "value, op, other, truth",
    [("10", "=", 10, True), ("10.0", "=", 10, True), ("abc", "=", 10, False), ("abc", "!=", 10, True), (None, "!=", 10, False), (None, "=", "a", False), ("9", "<", 10, True), ("abc", "<", 10, False), ("a", "=", "a", True), ("a", "!=", "b", True), ("10", ">=", 10, True), ("11", ">", 10, True), ("10", "<=", 9, False)],
)
def test_tolerant(spark, value, op, other, truth):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(tolerant.compare(F.col("v"), op, other)).first()[0] is truth


def test_tolerant_cast(spark):
    df = spark.createDataFrame([("7.9", "x")], "a string, b string")
    assert tuple(df.select(tolerant.cast(F.col("a"), "BIGINT"), tolerant.cast(F.col("b"), "DOUBLE"), tolerant.cast(F.col("a"), "VARCHAR")).first()) == (7, None, "7.9")
