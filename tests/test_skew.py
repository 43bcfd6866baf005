import pytest
from pyspark.sql import functions as F

from rillstone.operators import skew


@pytest.mark.parametrize("hot", [None, [1, 2], []])
def test_lookup_is_a_left_join(spark, hot):
    rows = [(1, i) for i in range(300)] + [(2, 1), (3, 1), (None, 5), (9, 0)]
    left = spark.createDataFrame(rows, "k bigint, x bigint")
    right = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k bigint, v string")
    got = sorted(map(tuple, skew.lookup(left, right, "k", ["x"], hot).collect()), key=repr)
    names = {1: "a", 3: "c"}
    assert got == sorted([(k, x, names.get(k)) for k, x in rows], key=repr)


def test_hot_keys_are_few(spark):
    df = spark.createDataFrame([(i % 100,) for i in range(1000)] + [(7,)] * 500 + [(None,)] * 900, "k bigint")
    assert skew.hot_keys(df, "k", 10) == [7]
    assert skew.hot_keys(df.limit(0), "k") == []


def test_what_finds_nothing_is_spread(spark):
    """Null keys and hot keys must be hashed by their own part of the join key."""
    left = spark.range(1000).selectExpr("cast(null as bigint) as k", "id as x")
    right = spark.range(1000).selectExpr("id as k", "id as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = skew.lookup(left, right, "k", ["x"], [])
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 1000 and max(sizes) < 500


@pytest.mark.parametrize("hot", [[1, 2], []])
def test_salted_is_a_left_join(spark, hot):
    rows = [(1, i) for i in range(300)] + [(2, 1), (3, 1), (None, 5), (9, 0)]
    left, right = spark.createDataFrame(rows, "k bigint, x bigint"), spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k bigint, v string")
    got = sorted(map(tuple, skew.salted(left, right, "k", ["x"], hot).collect()), key=repr)
    assert got == sorted([(k, x, {1: "a", 3: "c"}.get(k)) for k, x in rows], key=repr)
