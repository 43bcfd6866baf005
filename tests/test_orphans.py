"""Orphan references and their cascade against a plain walk."""

import datetime as dt
import random

import pytest

from rillstone.operators import orphans as O

T0 = dt.datetime(2024, 1, 1)
FEED = "revision_id bigint, parent_id bigint, received_at timestamp_ntz, t string"
REC, DEL, KEPT = "id bigint, loaded_at timestamp_ntz", "revision_id bigint, cleaned_at timestamp_ntz", "id bigint, key string"


def d(n):
    return T0 + dt.timedelta(days=n)


def frames(spark, feed, rec, dele, kept):
    return spark.createDataFrame(feed, FEED), spark.createDataFrame(rec, REC), spark.createDataFrame(dele, DEL), spark.createDataFrame(kept, KEPT)


def test_reasons(spark):
    feed = [(1, 2, d(5), ""), (1, 2, d(3), ""), (1, None, d(40), ""), (4, 5, d(1), ""), (6, 7, None, ""), (None, 2, d(1), ""), (8, 1, d(50), "")]
    rec = [(1, d(0)), (2, d(4)), (4, d(0)), (4, d(9)), (5, d(0)), (6, None), (7, d(3)), (8, d(0))]
    dele = [(4, d(5)), (5, d(2)), (5, d(2)), (7, None), (99, d(1))]
    rows = O.orphan_report(*frames(spark, feed, rec, dele, [(9, "")])).collect()
    assert sorted(map(tuple, rows)) == sorted([
        ("direct", "parent_id", 1, 2, "late", "2024-01"), ("direct", "parent_id", 4, 5, "deleted", "2024-01"), ("inherited", "parent_id", 8, 1, "inherited", "2024-02"),
    ])


def test_missing_kept_and_empty(spark):
    f = frames(spark, [(1, 2, d(0), "")], [], [], [(2, "")])
    assert [tuple(r) for r in O.orphan_report(*f).collect()] == [("direct", "revision_id", 1, 2, "missing", "2024-01")]
    f = frames(spark, [], [(1, d(0))], [], [])
    assert O.orphan_report(*f).collect() == []


@pytest.mark.parametrize("size", [3, 200_000])
def test_cascade(spark, size, monkeypatch):
    monkeypatch.setattr(O, "LINKS_PER_RANGE", size)
    rng = random.Random(size)
    links = {(v, rng.randrange(max(1, v - 4), v)) for v in range(2, 40) for _ in range(2)} | {(50, 51), (51, 50), (51, 30), (60, 0)}
    seeds = {7, 33, 60}
    want, grown = set(seeds), True
    while grown:
        new = {c for c, p in links if p in want} - want
        want, grown = want | new, bool(new)
    df = spark.createDataFrame([(c, p, T0) for c, p in links], "revision_id bigint, parent_id bigint, t timestamp_ntz")
    got = O.cascade(df, spark.createDataFrame([(s,) for s in seeds], "revision_id bigint"))
    assert {r["revision_id"] for r in got.collect()} == want and got.count() == len(want)


def test_counts(spark):
    f = frames(spark, [(1, 2, d(0), ""), (3, 2, d(0), "")], [(1, d(0)), (3, d(0))], [], [])
    assert [tuple(r) for r in O.orphan_counts(O.orphan_report(*f)).collect()] == [("direct", "parent_id", "missing", "2024-01", 2)]


def test_direct_orphans_come_through_the_cascade(spark, monkeypatch):
    """Direct rows are the cascade's round 0: without it there are none."""
    f = frames(spark, [(1, 2, d(0), ""), (3, 1, d(0), "")], [(1, d(0)), (3, d(0))], [], [])
    assert sorted(r["kind"] for r in O.orphan_report(*f).collect()) == ["direct", "inherited"]
    real = O.cascade
    monkeypatch.setattr(O, "cascade", lambda links, direct: real(links, direct).limit(0))
    assert O.orphan_report(*f).collect() == []


def test_rounds_of_a_long_history(spark, monkeypatch):
    """A chain whose ids follow it goes through each range once."""
    monkeypatch.setattr(O, "LINKS_PER_RANGE", 700)
    df = spark.createDataFrame([(i, i - 1, T0) for i in range(2, 2002)], "revision_id bigint, parent_id bigint, t timestamp_ntz")
    got = O.cascade(df, spark.createDataFrame([(2,)], "revision_id bigint"))
    rounds = {r["round"]: r["count"] for r in got.groupBy("round").count().collect()}
    assert sum(rounds.values()) == 2000 and max(rounds) <= 4
