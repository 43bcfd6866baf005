"""Queries that do the whole job: no orders, late log rows or descendants left out."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rillstone.operators import hierarchy as H
from rillstone.scratch import new_dir
from rillstone.sources import logs
from rillstone.sources.manifest import Conflict, Diff, State
from rillstone.streaming import ingest
from tests.conftest import DATA

SF = str(DATA / "sf0.001")
tables = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test tables here")


@tables
def test_sorted_reduce_has_every_order(spark):
    orders = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    got = entry.queries()["cast_sorted_reduce"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, orders.collect()))


@tables
def test_sorted_reduce_sorts_the_whole_table(spark):
    """The range is taken from the result: no condition is left at the scan."""
    plan = entry.queries()["cast_sorted_reduce"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[plan.index("MapInPandas") :]


# ---- logs


def _log(spark):
    from tests.test_cube import small

    root = new_dir(spark, "log")
    c, store = small(spark)
    consumers = [(lambda r: r, {"k": F.col("k"), "s": F.col("s")}, {"n": None, "v": F.col("k")}, None)]

    def write(hour, part, n):
        logs.write_log(spark.range(n).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("s")), root, F.lit(part), F.lit(f"2024-01-01 {hour:02d}:00:00").cast("timestamp"))

    return root, c, store, write, lambda: ingest.ingest_log(spark, root, store, consumers, "l")


def _counts(c):
    from tests.test_cube import answer

    return [n for _, n, _ in answer(c)]


def test_rows_appended_to_an_hour_and_late_rows(spark):
    root, c, store, write, run = _log(spark)
    write(2, "a:b", 2)
    run()
    write(2, "a:b", 1)
    write(1, "a:b", 2)
    assert run() is not None and run() is None
    assert _counts(c) == [3, 2] and store.manifest.state().positions == {"l/a:b": "2024-01-01_02"}
    store.manifest.snapshot()
    assert store.manifest.forget() == 2 and run() is None


def test_rows_between_listing_and_reading(spark, monkeypatch):
    root, c, store, write, run = _log(spark)
    write(5, "a", 1)
    write(1, "b", 1)
    listed = logs.files

    def then_more(*a):
        found = listed(*a)
        write(2, "b", 1)
        return found

    monkeypatch.setattr(logs, "files", then_more)
    run()
    monkeypatch.undo()
    assert _counts(c) == [2]
    assert run() is not None and run() is None and _counts(c) == [3]


def test_files_of_a_diff():
    a, b = Diff(read={"l": ["1", "2"]}), Diff(read={"l": ["3"]}, unread={"l": ["2"]})
    assert a.squash(b) == Diff(read={"l": ["1", "3"]}) and a.squash(a.invert()).is_empty() and not a.is_empty()
    assert Diff.from_json(b.to_json()) == b
    s = State()
    s.apply(0, a)
    with pytest.raises(Conflict):
        s.apply(1, a)


def test_two_readers_of_a_log(spark):
    root, c, store, write, run = _log(spark)
    write(1, "a", 1)
    run()
    with pytest.raises(Conflict):
        store.ingest({}, {"l/a": ("2024-01-01_01", "2024-01-01_01")}, {"l/a": list(logs.files(spark, root)["a"])})


def test_position_without_files(spark):
    """A state written before files were kept."""
    root, c, store, write, run = _log(spark)
    write(1, "a", 2)
    store.manifest.commit(Diff(positions={"l/a": (None, "2024-01-01_01")}), -1)
    assert run() is None
    write(2, "a", 1)
    run()
    write(1, "a", 1)
    run()
    assert _counts(c) == [2]


# ---- descendants on and below circles


def _ways(parents):
    """node -> its ancestors by steps, each once."""
    out = {}
    for v in parents:
        seen = [v]
        while (x := parents.get(seen[-1])) is not None and x not in seen:
            seen.append(x)
        out[v] = seen
    return out


@pytest.mark.parametrize("bound", [1_000_000, 3])
def test_descendants_on_and_below_circles(spark, bound):
    rng = random.Random(bound)
    parents = {v: rng.choice([None, rng.randrange(1, v)]) for v in range(2, 20)}
    parents |= {100: 101, 101: 102, 102: 100, 103: 100, 104: 103, 105: 104, 106: 101, 110: 110, 111: 110, 120: 122, 121: 120, 122: 121, 200: 999}
    parents |= {v: rng.choice([102, *range(300, v)]) for v in range(300, 320)}
    ways = _ways(parents)
    df = spark.createDataFrame([*parents.items()], "node bigint, parent bigint")
    pairs = [(a, v, i) for v, way in ways.items() for i, a in enumerate(way) if i]
    assert sorted(map(tuple, H.whole_closure(df, bound).collect())) == sorted(pairs)
    ring = {v for v, way in ways.items() if parents.get(way[-1]) == v}
    got = {r["node"]: r for r in H.whole_paths(df, bound).collect()}
    assert set(got) == set(parents)
    for v, way in ways.items():
        met = [i for i, a in enumerate(way) if a in ring]
        path = way[: met[0] + 1] if met else way
        assert (got[v]["path"], got[v]["circle"]) == (path[::-1], min((way[i] for i in met), default=None))
        assert got[v]["descendants"] == sum(a == v for a, _, _ in pairs)


def test_whole_hierarchies_of_nothing(spark):
    df = spark.createDataFrame([], "node bigint, parent bigint")
    assert H.whole_closure(df).collect() == [] and H.whole_paths(df).collect() == []


def test_chunks_alive_with_every_field(spark, tmp_path):
    """Changes that set only measures or meta are seen."""
    first = '[{"ops":[{"daily":{"added":[{"id":1,"count":3,"measures":["m"],"meta":{"node":"n","tags":[{"k":"a","v":"b"}]}}]}}]}]'
    then = '[{"ops":[{"daily":{"added":[{"id":1,"measures":["x","y"],"meta":{"tags":[{"k":"c","v":null},{"k":"d","v":"e"}]}}]}}]}]'
    spark.createDataFrame([(1, None, first), (2, 1, then)], "revision_id bigint, parent_id bigint, diff string").write.parquet(f"{tmp_path}/diffs.parquet")
    spark.createDataFrame([(1, 1, "INNER"), (2, 2, "INNER")], "id bigint, level bigint, type string").write.parquet(f"{tmp_path}/revisions.parquet")
    spark.createDataFrame([], "id bigint, level bigint").write.parquet(f"{tmp_path}/revisions_backup.parquet")
    got = entry.queries()["p2_state_all"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(1, 2, None, None, 3, ["x", "y"], "n", ["c", "d"], [None, "e"])]


def test_postings_of_whole_texts(spark, tmp_path):
    rows = [(1, "the cat\n the  dog"), (2, "the\tend"), (3, None), (4, ""), (5, " the ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["inverted_index_documents"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("cat", 1), ("dog", 1), ("end", 2), ("the", 1), ("the", 2), ("the", 5)]


@tables
def test_page_rank_over_a_table(spark):
    """What has no links gives nothing on, so after ten steps only pages ten links up are left, with less in all."""
    pages = spark.read.parquet(f"{SF}/diffs.parquet").where("parent_id is not null").select("revision_id").distinct().count()
    got = entry.queries()["page_rank_links"](spark, SF).collect()
    assert len(got) > 3 and 0 < sum(r["rank"] for r in got) <= pages
