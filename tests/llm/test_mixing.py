"""The mixture against a plain schedule."""

import math

import pytest
from pyspark.sql import functions as F

from rillstone.llm import mixing as M

DOCS = "doc_id bigint, text string, source string, slot bigint, weight double"
TARGETS = "source string, weight double, max_repeats int"


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def targets(spark, rows):
    return spark.createDataFrame(rows, TARGETS)


def plain(rows, wanted, block):
    """slot -> source and rank by the definition."""
    total = sum(n for _, s, n in rows if s in dict((t[0], 1) for t in wanted))
    whole, out, seen = sum(w for _, w, _ in wanted), [], {}
    for k in range(math.ceil(total / block)):
        x, run = ((k + 1) * M.GOLDEN) % 1.0, 0.0
        for s, w, _ in sorted(wanted):
            run += w / whole
            if x < run:
                break
        out.append((k, s, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + 1
    return out


@pytest.mark.parametrize("bucket", [50_000, 7])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "PER_BUCKET", bucket)
    rows = [(i, "big", 10 + i % 7) for i in range(300)] + [(1000 + i, "small", 20) for i in range(20)] + [(2000, "other", 9)]
    wanted = [("big", 6.0, 1), ("small", 3.0, 3), ("none", 1.0, 2)]
    s, t = sized(spark, rows + rows[:5]), targets(spark, wanted)
    listed = s.where(F.col("source") != "other")
    block = 50
    out = M.mix(listed, t, block).collect()
    slots = {(k, src): r for k, src, r in plain(rows, wanted, block)}
    assert {(r["slot"], r["source"]) for r in out} <= set(slots)
    whole = sum(n for _, src, n in rows if src != "other")
    by = {src: [r for r in out if r["source"] == src] for src in ("big", "small")}
    for src, (w, cap) in {"big": (0.6, 1), "small": (0.3, 3)}.items():
        own = by[src]
        uses = {}
        for r in own:
            uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
        assert max(uses.values()) <= cap and len({(r["doc_id"], r["repeat"]) for r in own}) == len(own)
        have = sum(n for _, x, n in rows if x == src) * cap
        assert abs(sum(r["n_tokens"] for r in own) - min(have, w * whole)) <= 2.5 * block
    # A source is not gone through again before all of it was used.
    again = {r["repeat"] for r in by["small"]}
    assert again == set(range(1, max(again) + 1)) and all(sum(r["repeat"] == k for r in by["small"]) == 20 for k in range(1, max(again)))
    assert sorted(map(tuple, M.mix(listed, t, block).collect())) == sorted(map(tuple, out))


def test_schedule_matches_the_definition(spark, monkeypatch):
    monkeypatch.setattr(M, "PER_BUCKET", 10)
    wanted = [("a", 5.0, 1), ("b", 3.0, 1), ("c", 2.0, 1)]
    t = M.read_targets(targets(spark, wanted))
    rows = [(0, "a", 50), (1, "b", 30), (2, "c", 20)]
    assert sorted(map(tuple, M.schedule(spark, 100, t).collect())) == plain(rows, wanted, 1)


def test_shares_and_odd_targets(spark):
    s = sized(spark, [(1, "a", 100), (2, "a", 100), (3, "b", 10), (4, "b", 0)])
    t = targets(spark, [("a", 1.0, None), ("b", 1.0, 2), ("b", 0.5, 1), (None, 9.0, 1), ("c", 0.0, 1), ("d", None, 1), ("e", 2.0, 5)])
    r = {x["source"]: x for x in M.shares(M.mix(s, t, 10), s, t).collect()}
    assert set(r) == {"a", "b", "e"} and r["b"]["most_repeats"] == 2 and r["b"]["tokens"] == 20
    assert r["e"]["tokens"] == 0 and r["e"]["shortfall"] == 105 and r["a"]["target_tokens"] == 53  # 52.5
    assert abs(sum(x["share_of_mix"] for x in r.values()) - 1) < 1e-9


def test_no_repeats_allowed_and_empty(spark):
    s = sized(spark, [(1, "a", 100)])
    assert M.mix(s, targets(spark, [("a", 1.0, 0)]), 10).collect() == []
    assert M.mix(s.limit(0), targets(spark, [("a", 1.0, 1)]), 10).collect() == []
    assert M.mix(s, targets(spark, []), 10).collect() == []
    t = targets(spark, [])
    assert M.shares(M.mix(s, t), s, t).collect() == []


def test_sizes(spark):
    docs = spark.createDataFrame([(1, "hello world", "a", 0, 0.0), (2, None, "a", 0, 0.0), (3, "", "b", 0, 0.0), (4, "x", "A", 0, 0.0), (None, "x", "a", 0, 0.0), (5, "x", None, 0, 0.0)], DOCS)
    t = targets(spark, [("a", 1.0, 1), ("b", 1.0, 1)])
    assert sorted(map(tuple, M.sizes(docs, t).collect())) == [(1, "a", 2), (2, "a", 0), (3, "b", 0)]
    assert M.sizes(docs, t.limit(0)).collect() == []


def test_shares_are_within_a_percent(spark):
    """Sources below their caps get their share within 1%, also where it takes several passes; the block follows from the total."""
    rows = [(i, "big", 40 + i % 9) for i in range(3000)] + [(10_000 + i, "small", 30 + i % 5) for i in range(200)] + [(20_000 + i, "mid", 25) for i in range(1500)]
    s, t = sized(spark, rows), targets(spark, [("big", 5.0, 3), ("small", 1.0, 9), ("mid", 2.5, 4)])
    for r in M.shares(M.mix(s, t), s, t).collect():
        assert abs(r["tokens"] / r["target_tokens"] - 1) < 0.01, r
    assert M.block_size(10**15, M.read_targets(t)) == M.BLOCK_TOKENS


def test_many_sources(spark):
    wanted = [(f"s{i:04d}", 1.0 + i % 3, 1) for i in range(2000)]
    t = M.read_targets(targets(spark, wanted))
    got = {r["source"]: r["n"] for r in M.schedule(spark, 40_000, t).groupBy("source").agg(F.count("*").alias("n")).collect()}
    whole = sum(w for _, w, _ in wanted)
    assert all(abs(got[s] - 40_000 * w / whole) < 5 for s, w, _ in wanted)
