"""The reporting cube's published results, stored and in memory; evolution, upkeep, ingestion."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rillstone.functions import computed as C
from rillstone.functions import measures as M
from rillstone.functions import predicates as P
from rillstone.plans.cube import Attribute, Cube, CubeQuery, QueryError, Rollup
from rillstone.queries.engine import _COLUMNS, _DIMS, _INPUTS, ads_cube
from rillstone.scratch import new_dir
from rillstone.sources import logs
from rillstone.sources.manifest import Conflict, Diff, Manifest
from rillstone.sources.rollups import RollupStore, TooManyOverlaps
from rillstone.streaming import ingest

# The published input rows of the reporting example.
ADVERTISERS = [(1, 1, 1, 1, 20, 3, 1, 0.12, 2, 2), (1, 2, 2, 2, 100, 5, 0, 0.36, 10, 0), (1, 3, 3, 3, 80, 5, 0, 0.60, 1, 8), (2, 1, 1, 1, 15, 2, 0, 0.22, 1, 3), (3, 1, 1, 1, 30, 5, 2, 0.30, 3, 4)]
AFFILIATES = [(1, 10, 3, 1, 0.12, 0, 2, 1, "site3.com"), (1, 15, 2, 0, 0.22, 0, 3, 2, "site3.com"), (1, 30, 5, 2, 0.30, 0, 4, 2, "site3.com"), (1, 100, 5, 0, 0.36, 0, 0, 3, "site2.com"), (1, 80, 5, 0, 0.60, 0, 8, 4, "site1.com"), (2, 20, 1, 12, 0.8, 0, 3, 4, "site1.com"), (2, 30, 2, 13, 0.9, 0, 2, 4, "site1.com"), (3, 40, 3, 2, 1.0, 0, 1, 4, "site1.com")]
DAY = dt.date(2000, 1, 1)
SCHEMA = "log_date date, advertiser int, campaign int, banner int, impressions bigint, clicks bigint, conversions bigint, revenue double, user_id int, errors int, affiliate int, site string"


def log_rows(spark):
    rows = [(DAY + dt.timedelta(a[0]), *a[1:], 0, "--") for a in ADVERTISERS] + [(DAY + dt.timedelta(a[0]), 0, 0, 0, *a[1:]) for a in AFFILIATES]
    return spark.createDataFrame(rows, SCHEMA)


def inputs():
    return {k: F.col(c) for k, c in _COLUMNS.items()}, {k: None if c is None else F.col(c) for k, c in _INPUTS.items()}


@pytest.fixture(scope="module", params=["memory", "stored"])
def cube(request, spark):
    c = ads_cube(spark)
    names = spark.createDataFrame([(1, "first"), (2, None), (3, "third")], "advertiser int, name string")
    c.attributes["advertiser.name"] = Attribute(names, {"advertiser": "advertiser"}, "name")
    parts = c.consume(log_rows(spark), *inputs())
    if request.param == "memory":
        for k, v in parts.items():
            c.attach(k, v)
    else:
        store = RollupStore(spark, new_dir(spark, "cube"), c)
        for half in (0, 1):
            store.ingest(c.consume(log_rows(spark).where(F.col("impressions") % 20 == 10 * half) if half else log_rows(spark).where(F.col("impressions") % 20 != 10), *inputs()))
    return c


def rows(df):
    return [tuple(r) for r in df.collect()]


NO = P.and_(P.ne("advertiser", 0), P.ne("campaign", 0), P.ne("banner", 0))


def test_by_date(cube):
    where = P.between("date", DAY + dt.timedelta(1), DAY + dt.timedelta(2))
    r = cube.query(CubeQuery(("date",), ("clicks", "impressions"), where=where, order=(("date", False),)))
    assert rows(r.records) == [(DAY + dt.timedelta(2), 5, 65), (DAY + dt.timedelta(1), 33, 435)]
    t = cube.query(CubeQuery(("date",), ("clicks", "impressions", "ctr"), where=where))
    assert rows(t.totals) == [(38, 500, pytest.approx(7.6))] and t.total_count.collect()[0]["n"] == 2


def test_by_date_all(cube):
    r = cube.query(CubeQuery(("date",), ("impressions", "eventCount", "minRevenue", "maxRevenue"), order=(("date", True),)))
    assert [x[1:] for x in rows(r.records)] == [(435, 8, 0.12, 0.6), (65, 3, 0.22, 0.9), (70, 2, 0.3, 1.0)]
    assert rows(r.totals) == [(570, 13, 0.12, 1.0)]


def test_banner_and_exclusions(cube):
    r = cube.query(CubeQuery(("date",), ("clicks", "impressions"), where=P.and_(NO, P.eq("banner", 1)), order=(("ctr", True),)))
    assert [x[1:] for x in rows(r.records)][:2] == [(2, 15), (3, 20)]


def test_null_attribute_and_having(cube):
    q = CubeQuery(("date", "advertiser", "advertiser.name"), ("impressions",), where=NO, having=P.or_(P.eq("advertiser.name", None), P.regexp("advertiser.name", "f.*")), order=(("date", True), ("advertiser", True)), limit=2)
    r = cube.query(q)
    assert rows(r.records) == [(DAY + dt.timedelta(1), 1, "first", 20), (DAY + dt.timedelta(1), 2, None, 100)]
    assert r.total_count.collect()[0]["n"] == 4 and rows(r.totals) == [(245,)]


@pytest.mark.parametrize(("dims", "where", "want"), [(("advertiser",), NO, (200, 13, 1.08, 10)), (("date",), P.always_true(), (435, 33, 2.68, 27))])
def test_totals_of_rollups(cube, dims, where, want):
    q = CubeQuery(dims, ("impressions", "clicks", "revenue", "errors"), where=P.and_(where, P.eq("date", DAY + dt.timedelta(1))))
    assert rows(cube.query(q).totals) == [tuple(pytest.approx(x) for x in want)]


def test_affiliates_total(cube):
    q = CubeQuery(("affiliate",), ("impressions", "clicks", "revenue"), where=P.and_(P.ne("affiliate", 0), P.ne("site", "--"), P.eq("date", DAY + dt.timedelta(1))))
    assert rows(cube.query(q).totals) == [(235, 20, pytest.approx(1.60))]


def test_metadata_filters_and_json(cube):
    assert cube.query(CubeQuery(("date",), ("clicks", "nothing"), report="metadata")).to_dict() == {"metadata": {"attributes": ["date"], "measures": ["clicks"]}}
    q = CubeQuery.from_params({"attributes": "campaign", "measures": "clicks", "where": '{"advertiser": 1, "campaign <>": 0, "banner <>": 0}', "sort": "clicks:desc", "limit": "1", "reportType": "DATA"}, cube)
    out = cube.query(q).to_dict()
    assert out == {"metadata": {"attributes": ["campaign"], "measures": ["clicks"]}, "sortedBy": ["clicks"], "records": [{"campaign": 1, "clicks": 10}], "count": 1, "filterAttributes": {"advertiser.name": "first"}}


def test_errors(cube):
    with pytest.raises(QueryError, match="Attribute not found"):
        cube.query(CubeQuery(("planet",), ("clicks",)))
    with pytest.raises(QueryError):
        cube.query(CubeQuery(("date", "site", "banner"), ("clicks",)))
    with pytest.raises(QueryError):
        CubeQuery.from_params({"sort": "a:up"}, cube)
    with pytest.raises(QueryError):
        cube.consume(log_rows(cube.query(CubeQuery(("date",), ("clicks",))).records.sparkSession), {}, {})
    assert cube.drill_down("banner") == ["advertiser", "campaign", "banner"]


def test_offset_beyond_the_end_and_false_where(cube):
    assert rows(cube.query(CubeQuery(("date",), ("clicks",), offset=99)).records) == []
    r = cube.query(CubeQuery(("date",), ("clicks", "ctr"), where=P.always_false()))
    assert rows(r.records) == [] and rows(r.totals) == [(0, 0.0)]


def test_routing():
    c = Cube(_DIMS, {k: M.count() for k in ("a", "b")}, [Rollup("one", ("date", "site"), ("a", "b")), Rollup("two", ("date",), ("a",)), Rollup("three", ("date",), ("a", "b"), P.between("date", 1, 9))])
    for r in c.rollups:
        c.attach(r, lambda w, m: None)
    names = lambda *a: [r.name for r in c.candidates(*a)]
    assert names(["date"], ["a"], P.always_true()) == ["two", "one"]
    assert names(["date"], ["a", "b"], P.always_true()) == ["one", "two"]
    assert names(["date"], ["b"], P.eq("date", 4)) == ["three", "one"]
    assert names(["date"], ["b"], P.eq("date", 40)) == ["one"]
    assert names(["site"], ["b"], P.always_true()) == ["one"] and names(["banner"], ["b"], P.always_true()) == []


def test_consume_filters_and_coverage(spark):
    c = ads_cube(spark)
    every = c.consume(log_rows(spark), *inputs(), P.eq("advertiser", 0))
    assert set(every) == {"daily", "affiliates"}


# ---- stored rollups


def small(spark, root=None, **more):
    c = Cube({"k": "int", "s": "string"}, {"n": M.count(), "v": M.sum_("bigint")}, [Rollup("r", ("k", "s"), ("n", "v"), **more)])
    return c, RollupStore(spark, root or new_dir(spark, "cube"), c, chunk_rows=100)


def put(spark, store, lo, hi, measures=("n", "v")):
    df = spark.range(lo, hi).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("s"), F.col("id").alias("v"))
    m = {"n": None, "v": F.col("v")}
    store.ingest(store.cube.consume(df, {"k": F.col("k"), "s": F.col("s")}, {k: m[k] for k in measures}))


def answer(c, where=None):
    return rows(c.query(CubeQuery(("k",), ("n", "v"), where=where or P.always_true(), order=(("k", True),))).records)


def test_chunks_prune_consolidate_vacuum_backup(spark):
    c, store = small(spark)
    for lo, hi in ((0, 250), (200, 450), (900, 950)):
        put(spark, store, lo, hi)
    want = [(k, 1 + (200 <= k < 250), k * (1 + (200 <= k < 250))) for k in [*range(450), *range(900, 950)]]
    assert answer(c) == want
    n = len(store.find("r", P.always_true(), ("n",)))
    assert n >= 6 and len(store.find("r", P.eq("k", 930), ("n",))) == 1 and store.find("r", P.eq("k", 700), ("n",)) == [] and store.find("r", P.always_false(), ()) == []
    assert answer(c, P.between("k", 240, 260)) == [x for x in want if 240 <= x[0] <= 260]
    assert store.overlap("r") >= 2 and store.segments("r") and store.missing() == set()
    assert store.consolidate("r", "hot") and answer(c) == want and store.overlap("r") <= 1
    while store.consolidate("r", "min_key"):
        assert answer(c) == want
    assert not store.consolidate("r", "hot")
    gone = store.vacuum(0)
    assert gone >= 3 and answer(c) == want and store.missing() == set() and store.vacuum(0) == 0
    to = new_dir(spark, "backup")
    store.backup(to)
    c2, _ = small(spark, to)
    assert answer(c2) == want


def test_partition_key_measure_evolution_and_throttle(spark):
    c, store = small(spark, partition_by=("k",))
    put(spark, store, 0, 5, ("n",))
    assert all(x["min"][0] == x["max"][0] for x in store.manifest.state().chunks["r"].values())
    assert answer(c)[:2] == [(0, 1, 0), (1, 1, 0)]
    put(spark, store, 0, 2)
    assert answer(c)[:3] == [(0, 2, 0), (1, 2, 1), (2, 1, 0)]
    store.max_overlap = 0
    with pytest.raises(TooManyOverlaps):
        put(spark, store, 0, 2)


def test_empty_store(spark):
    c, store = small(spark)
    assert answer(c) == [] and not store.consolidate("r") and store.overlap("r") == 0


def test_diffs_and_manifest(spark):
    a, b = Diff({"t": {"1": {}}}, {}, {"l": (0, 5)}), Diff({"t": {"2": {}}}, {"t": {"1": {}}}, {"l": (5, 9)})
    assert a.squash(b) == Diff({"t": {"2": {}}}, {}, {"l": (0, 9)}) and a.squash(a.invert()).is_empty()
    assert b.conflicts(Diff(removed={"t": {"1": {}}})) and not a.conflicts(Diff({"t": {"3": {}}})) and b.wins(a) and not a.wins(b)
    m = Manifest(spark, new_dir(spark, "manifest"))
    v = m.commit(a, -1)
    assert m.commit(Diff({"t": {"3": {}}}), -1) == v + 1  # rebased
    with pytest.raises(Conflict):
        m.commit(Diff(positions={"l": (0, 7)}), -1)
    m.commit(Diff(removed={"t": {"1": {}}}), v + 1)
    m.snapshot()
    assert m.forget() == 3 and set(m.state().chunks["t"]) == {"3"} and m.state().positions == {"l": 5}
    assert m.commit(Diff({"t": {"4": {}}}), v + 2) == v + 3
    m.commit(Diff(removed={"t": {"9": {}}}), v + 3)
    with pytest.raises(Conflict):
        m.state()


# ---- logs


def test_log_names():
    f = logs.LogFile("2023-04-01_05", 3)
    assert f.name("p1") == "2023-04-01_05.p1-3" and logs.parse_name("x/2023-04-01_05.p1-3.log", ".log") == ("p1", f)
    assert logs.LogFile("2023-04-01_05") < f < logs.LogFile("2023-04-01_06") and logs.parse_name("nothing") is None
    with pytest.raises(ValueError):
        f.name("a-b")


def test_ingest_resumes(spark):
    root = new_dir(spark, "log")
    c, store = small(spark)
    m = [(lambda r: r, {"k": F.col("k"), "s": F.col("s")}, {"n": None, "v": F.col("k")}, None)]

    def write(hour, part, n):
        logs.write_log(spark.range(n).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("s")), root, F.lit(part), F.lit(f"2024-01-01 {hour:02d}:00:00").cast("timestamp"))

    write(1, "a", 3)
    write(1, "b", 2)
    assert ingest.ingest_log(spark, root, store, m, "l") is not None
    write(2, "a", 1)
    assert ingest.ingest_log(spark, root, store, m, "l") is not None and ingest.ingest_log(spark, root, store, m, "l") is None
    assert [(k, n) for k, n, _ in answer(c)] == [(0, 3), (1, 2), (2, 1)]
    assert store.manifest.state().positions == {"l/a": "2024-01-01_02", "l/b": "2024-01-01_01"}
    assert logs.read_log(spark, root, ["b"]).count() == 2


# ---- measures and expressions

EVENTS = [[(1, 0.34, 1), (2, 0.42, 3), (3, 0.13, 20)], [(2, 0.30, 20), (1, 0.22, 1000), (2, 0.91, 33)], [(1, 0.01, 1), (3, 0.88, 20), (3, 1.01, 21)], [(1, 0.35, 500), (1, 0.59, 17), (2, 0.85, 50)]]


def test_every_measure(spark):
    ms = {"n": M.count(), "sum": M.sum_(), "min": M.min_(), "max": M.max_(), "set": M.union(), "about": M.distinct()}
    c = Cube({"site": "int"}, ms, [Rollup("r", ("site",), tuple(ms))])
    store = RollupStore(spark, new_dir(spark, "cube"), c)
    for batch in EVENTS:
        df = spark.createDataFrame(batch, "site int, revenue double, user bigint")
        store.ingest(c.consume(df, {"site": F.col("site")}, {"n": None, "sum": F.col("revenue"), "min": F.col("revenue"), "max": F.col("revenue"), "set": F.col("user"), "about": F.col("user")}))
    store.consolidate("r")
    got = rows(c.query(CubeQuery(("site",), tuple(ms), order=(("site", True),))).records)
    want = [(1, 5, 1.51, 0.01, 0.59, [1, 17, 500, 1000], 4), (2, 4, 2.48, 0.30, 0.91, [3, 20, 33, 50], 4), (3, 3, 2.02, 0.13, 1.01, [20, 21], 2)]
    assert [(*x[:2], round(x[2], 6), *x[3:]) for x in got] == want


def test_inverted_index(spark):
    u = M.union()
    df = spark.createDataFrame([("fox", 1), ("brown", 2), ("fox", 3), ("brown", 3), ("lazy", 4), ("dog", 1), ("quick", 1), ("fox", 4), ("brown", 10)], "w string, d bigint")
    got = df.groupBy("w").agg(u.partial(F.col("d")).alias("d"))
    assert dict(map(tuple, got.collect())) == {"brown": [2, 3, 10], "dog": [1], "fox": [1, 3, 4], "lazy": [4], "quick": [1]}


@pytest.mark.parametrize(("m", "error"), [(64, 0.11), (128, 0.10), (256, 0.06)])
def test_estimate_error(spark, m, error):
    df = spark.range(20 * 1000).select((F.col("id") / 1000).cast("int").alias("g"), "id")
    got = [r["estimate"] for r in M.estimate(M.registers(df, ["g"], "id", m), ["g"], m).collect()]
    assert sum(abs(x - 1000) / 1000 for x in got) / len(got) <= error
    assert M.registers(df.limit(0), ["g"], "id", m).collect() == []


def test_expressions(spark):
    row = spark.createDataFrame([(3.0, 0.0, -4.0)], "a double, z double, n double")
    m = {c: F.col(c) for c in row.columns}
    e = {"div": C.div("a", 2), "by_zero": C.div("a", "z"), "root": C.sqrt("n"), "sqr": C.sqr("n"), "pct": C.percent("a", 4), "add": C.add("a", 1), "sub": C.measure("a") - 1, "mul": C.mul("a", "n"), "var": C.variance(value_("6"), value_("20"), value_("3"))}
    got = row.select(*(x.column(m).alias(k) for k, x in e.items())).collect()[0].asDict()
    assert got == {"div": 1.5, "by_zero": 0.0, "root": 0.0, "sqr": 16.0, "pct": 75.0, "add": 4.0, "sub": 2.0, "mul": -12.0, "var": pytest.approx(20 / 3 - 4)}
    assert C.div("a", "b").needs == {"a", "b"}


def value_(x):
    return C.value(float(x))


def test_unique_users(cube):
    """4, 2 and 2 users by day, also when the days' sketches are merged; null where nothing came is 0."""
    r = cube.query(CubeQuery(("date",), ("uniqueUserIdsCount", "uniqueUserPercent"), order=(("date", True),)))
    assert [x[1] for x in rows(r.records)] == [4, 2, 2] and [round(x[2], 4) for x in rows(r.records)] == [50.0, round(2 / 3 * 100, 4), 100.0]
    assert rows(r.totals)[0][0] == 5
    none = cube.query(CubeQuery(("date",), ("uniqueUserIdsCount",), where=P.always_false()))
    assert rows(none.totals) == [(0,)]


def test_one_look_at_the_manifest_a_query(spark):
    c, store = small(spark)
    for lo, hi in ((0, 250), (200, 450), (900, 950)):
        put(spark, store, lo, hi)
    looks, real = [], store.manifest.state
    store.manifest.state = lambda *a: looks.append(1) or real(*a)
    assert len(answer(c)) == 500 and len(looks) == 1
    assert len(answer(c, P.eq("k", 3))) == 1 and len(looks) == 2


def test_chunks_are_split_after_their_partitioning_changed(spark):
    root = new_dir(spark, "cube")
    make = lambda by: RollupStore(spark, root, Cube({"p": "int", "k": "int"}, {"n": M.count()}, [Rollup("r", ("p", "k"), ("n",), partition_by=by)]), 100)
    store = make(())
    df = spark.range(60).select((F.col("id") % 3).cast("int").alias("p"), F.col("id").cast("int").alias("k")).coalesce(1)
    store.ingest(store.cube.consume(df, {"p": F.col("p"), "k": F.col("k")}, {"n": None}))
    new = make(("p",))
    assert new.choose("r", "min_key") and new.consolidate("r", "min_key")
    while new.consolidate("r", "min_key"):
        pass
    chunks = new.manifest.state().chunks["r"].values()
    assert all(c["ranges"]["p"][0] == c["ranges"]["p"][1] for c in chunks) and sum(c["count"] for c in chunks) == 60
    assert not new.choose("r", "min_key") and new.cube.query(CubeQuery(("p",), ("n",), order=(("p", True),))).records.collect() == [(i, 20) for i in range(3)]


def test_small_neighbours_are_joined_up_to_a_chunk(spark):
    c, store = small(spark)
    for i in range(12):
        put(spark, store, 30 * i, 30 * i + 20)
    want = answer(c)
    while store.consolidate("r", "min_key"):
        pass
    counts = [x["count"] for x in store.manifest.state().chunks["r"].values()]
    assert answer(c) == want and sum(counts) == 240 and max(counts) <= store.chunk_rows


def test_attributes_of_repeated_keys(spark):
    table = spark.createDataFrame([(1, "b", 0), (1, "a", 9), (2, None, 0), (2, "c", 1)], "id int, name string, x int").repartition(4)
    assert sorted(map(tuple, Attribute(table, {"k": "id"}, "name").rows().collect()), key=repr) == [(1, "a", 9), (2, None, 0)]


def test_regexp_takes_the_whole_value(spark):
    df = spark.createDataFrame([("ab",), ("ab\n",), ("xab",), (None,)], "s string")
    at = lambda p: [r["s"] for r in df.where(P.regexp("s", p).column({"s": F.col("s")})).collect()]
    assert at("a.") == ["ab"] and at("ab|null") == ["ab", None] and at("(?s)ab.") == ["ab\n"]
