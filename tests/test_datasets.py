"""Datasets and replicated state on literal rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillstone.operators import crdt
from rillstone.operators import datasets as D


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sources(spark):
    assert rows(D.of(spark, iter([(1,), (2,)]), "v int")) == [(1,), (2,)] and rows(D.empty(spark, "v int")) == []
    with pytest.raises(Exception, match="broken"):
        D.failing(spark, "broken", "v int").collect()
    assert rows(D.generate(spark, 3, v=F.col("id") * 2)) == [(0,), (2,), (4,)]
    D.discard(spark.range(3))
    assert [r["id"] for r in D.collect(spark.range(3))] == [0, 1, 2]


def test_filter_sort_collect(spark):
    df = D.of(spark, [(v,) for v in (1, 2, 3, 4, 5, 6, 1, 6)], "value bigint")
    s = D.repartition_sort(df, "value", partitions=2)
    parts = s.select(F.spark_partition_id().alias("p"), "value").collect()
    assert sorted(r["value"] for r in parts) == [1, 1, 2, 3, 4, 5, 6, 6]
    for p in {r["p"] for r in parts}:
        own = [r["value"] for r in parts if r["p"] == p]
        assert own == sorted(own)
    assert [r["value"] for r in D.sort(df.where("value % 2 = 0"), "value").collect()] == [2, 4, 6, 6]
    assert [r["value"] for r in D.sort(df, "value", distinct_by=["value"]).collect()] == [1, 2, 3, 4, 5, 6]
    assert rows(D.top(df, 2, F.desc("value"))) == [(6,), (6,)]


def test_merge_and_concat(spark):
    a, b = D.of(spark, [(1, "a"), (3, "a")], "k int, v string"), D.of(spark, [(1, "b"), (2, "b")], "k int, v string")
    assert [tuple(r) for r in D.merge([a, b], ["k"], distinct=True).collect()] == [(1, "a"), (2, "b"), (3, "a")]
    assert [r["k"] for r in D.merge([a, b], ["k"]).collect()] == [1, 1, 2, 3]
    assert [tuple(r) for r in D.concat(a, b).orderBy("part", "k").collect()] == [(1, "a", 0), (3, "a", 0), (1, "b", 1), (2, "b", 1)]


def test_reducers(spark):
    df = D.of(spark, [(1, 5), (1, 7), (2, 1), (2, None)], "k int, v int")
    assert rows(D.reduce_by(df, ["k"], s=F.sum("v"))) == [(1, 12), (2, 1)]
    assert rows(D.fold_by(df.where("v is not null"), ["k"], F.col("v"), F.lit(1), lambda a, x: a * x, "p")) == [(1, 35), (2, 1)]
    assert rows(D.reduce_groups(df, ["k"], lambda g: pd.DataFrame({"k": g["k"], "n": len(g)}), "k int, n int")) == [(1, 2), (1, 2), (2, 2), (2, 2)]
    a, b = D.of(spark, [(1, 1.0)], "k int, m1 double"), D.of(spark, [(1, 2.0, 3.0), (3, 4.0, 5.0)], "k int, m2 double, m3 double")
    assert rows(D.merge_reduce([a, b], ["k"], m1=F.sum("m1"), m2=F.sum("m2"), m3=F.sum("m3"))) == [(1, 1.0, 2.0, 3.0), (3, None, 4.0, 5.0)]
    assert rows(D.first_by(df, ["k"], [F.desc("v")]).select("k", "v")) == [(1, 7), (2, 1)]


def test_joins(spark):
    left = D.of(spark, [(10, 10, "a"), (10, 15, "b"), (20, 10, "c"), (20, 25, "d"), (30, 40, "e")], "id int, detail int, name string")
    right = D.of(spark, [(10, "x"), (15, "y"), (10, "z")], "k int, text string")
    on = [("detail", "k")]
    assert rows(D.join(left, right, on, "left", unique_right=["text"]).select("name", "text")) == [("a", "x"), ("b", "y"), ("c", "x"), ("d", None), ("e", None)]
    assert D.join(left, right, on).count() == 5 and rows(D.join(left, right, on, "anti").select("name")) == [("d",), ("e",)] and D.join(left, right, on, "semi").count() == 3


def test_join_groups(spark):
    a, b = D.of(spark, [(1, 2), (1, 3), (2, 5)], "k int, v int"), D.of(spark, [(1, 10), (3, 7)], "k int, w int")
    joiner = lambda x, y: pd.DataFrame({"k": [*x["k"], *y["k"]][:1], "s": [int(x["v"].sum() + y["w"].sum())]})
    assert rows(D.join_groups(a, b, ["k"], joiner, "k int, s int")) == [(1, 15), (2, 5), (3, 7)]


def test_until(spark):
    df = D.of(spark, [(1, 1, "a"), (1, 2, "stop"), (1, 3, "b"), (2, 1, "c")], "g int, t int, v string")
    assert rows(D.until(df, F.col("v") == "stop", ["t"], ["g"]).select("g", "v")) == [(1, "a"), (2, "c")]
    assert rows(D.until(df, F.col("v") == "stop", ["t"]).select("v")) == [("a",), ("c",)]
    assert D.until(df, F.col("v") == "never", ["t"]).count() == 4


def test_routing(spark):
    df = D.of(spark, [(k,) for k in range(-50, 50)], "k bigint")
    assert {r["shard"] for r in D.shard(df, "k", 3).collect()} == {0, 1, 2}
    assert D.replicate(df, F.array(F.lit(1), F.lit(2))).count() == 200
    outs = D.route(df, low=F.col("k") < 0, all=F.lit(True))
    assert outs["low"].count() == 50 and outs["all"].count() == 100
    assert D.rendezvous(df, F.col("k"), ["a", "b", "c"], 2).groupBy("k").agg(F.countDistinct("shard").alias("n")).where("n <> 2").count() == 0


def test_page_rank(spark):
    pages = D.of(spark, [(1, [1, 2, 3]), (3, [1]), (2, [1])], "page bigint, links array<bigint>")
    got = {r["page"]: r["rank"] for r in D.page_rank(pages, 10).collect()}
    assert got == {1: pytest.approx(1.7861, abs=1e-3), 2: pytest.approx(0.6069, abs=1e-3), 3: pytest.approx(0.6069, abs=1e-3)}


def test_counters_and_sets(spark):
    s = D.of(spark, [("k", "a", 3, 1), ("k", "a", 5, 0), ("k", "b", 2, 4), ("j", "a", None, 2)], "key string, replica string, p int, n int")
    assert rows(crdt.g_counter(s.where("key = 'k'"), value="p")) == [("k", 7)] and rows(crdt.pn_counter(s)) == [("j", -2), ("k", 2)]
    a, r = D.of(spark, [("k", 1), ("k", 1), ("k", 2)], "key string, element int"), D.of(spark, [("k", 2)], "key string, element int")
    assert rows(crdt.g_set(a)) == [("k", 1), ("k", 2)] and rows(crdt.tp_set(a, r)) == [("k", 1)]
    ops = D.of(spark, [("k", 1, 5, False), ("k", 1, 5, True), ("k", 2, 5, False), ("k", 2, 6, True), ("k", 3, 1, True), ("k", 3, 0, False), ("k", 4, 9, None)], "key string, element int, at int, removed boolean")
    assert rows(crdt.lww_set(ops)) == [("k", 1), ("k", 4)]


def test_store(spark):
    rows_ = lambda s: {r["key"]: r["state"] for r in s.read().collect()}
    df = lambda d, ts: D.of(spark, [(k, v, ts) for k, v in d.items()], "key string, state int, ts int")
    s = crdt.Store({"state": F.max}, df({"mx": 22, "test": 1}, 1)).upload(df({"mx": 2, "test": 4, "only": 47}, 2)).upload(df({"mx": 23, "test": 3, "only": 12}, 3))
    assert rows_(s) == {"mx": 23, "test": 4, "only": 47}
    gone = s.remove(D.of(spark, [("mx", 3), ("test", 2)], "key string, ts int"))
    assert rows_(gone) == {"test": 4, "only": 47} and rows_(gone.consolidated()) == rows_(gone) and gone.consolidated().tombstones is None
    assert rows_(gone.upload(df({"mx": 1}, 4))) == {"mx": 23, "test": 4, "only": 47}
    assert {r["key"] for r in s.download(F.lit(4)).collect()} == set() and s.download().count() == 3
    assert rows_(crdt.Store.cluster([s, crdt.Store({"state": F.max}, df({"mx": 99}, 9))])) == {"mx": 99, "test": 4, "only": 47}


def test_map_rows(spark):
    df = spark.range(10, numPartitions=3)
    out = D.map_rows(df, lambda b: b[b.id % 2 == 0].assign(twice=lambda x: 2 * x.id), "id bigint, twice bigint")
    assert sorted(map(tuple, out.collect())) == [(i, 2 * i) for i in range(0, 10, 2)]
    assert D.map_rows(df.limit(0), lambda b: b.assign(twice=b.id), "id bigint, twice bigint").collect() == []
