"""Hierarchies against a plain walk, with small bounds so that both ways run."""

import itertools
import random

import numpy as np
import pytest

from rillstone.operators import hierarchy as H

EDGES = "node bigint, parent bigint"


def walk(parents):
    """node -> (root, depth, path, on_cycle) by following parents."""
    out = {}
    for v in parents:
        seen, x = [], v
        while x not in seen and parents.get(x) is not None:
            seen.append(x)
            x = parents[x]
        if x in seen:
            ring = seen[seen.index(x) :]
            out[v] = (min(ring), -1, None, v in ring)
        else:
            path = [x, *reversed(seen)]
            out[v] = (path[0], len(path) - 1, path, False)
    return out


def below(expected):
    n = {v: 0 for v in expected}
    for v, (_, _, path, _) in expected.items():
        for a in (path or [])[:-1]:
            if a in n:
                n[a] += 1
    return {v: n[v] if expected[v][1] >= 0 else None for v in n}


def check(spark, parents, bound):
    df = spark.createDataFrame([*parents.items()], EDGES)
    got = {r["node"]: r for r in H.hierarchies(df, ("path", "descendants"), bound).collect()}
    want = walk(parents)
    assert {v: (r["root"], r["depth"], r["path"], r["on_cycle"]) for v, r in got.items()} == want
    assert {v: r["descendants"] for v, r in got.items()} == below(want)


@pytest.mark.parametrize("bound", [1_000_000, 3])
def test_forest_with_cycles(spark, bound):
    rng = random.Random(bound)
    parents = {v: rng.choice([None, rng.randrange(max(1, v - 5), v), rng.randrange(1, v)]) if v > 1 else None for v in range(1, 60)}
    parents |= {100: 101, 101: 102, 102: 100, 103: 100, 104: 103, 110: 110, 111: 110, 200: 999}
    check(spark, parents, bound)


def test_long_chain_and_star(spark):
    check(spark, {v: v - 1 for v in range(2, 300)} | {v: 1 for v in range(1000, 1100)}, 50)


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2, 5, 6), (1, 2, 7, 8), (None, 2, 0, 0), (3, None, 0, 0)], EDGES + ", comp bigint, ptr bigint")
    assert sorted(map(tuple, H.hierarchies(df).collect())) == [(1, 2, 1, False), (3, 3, 0, False)]


def test_empty(spark):
    df = spark.createDataFrame([], EDGES)
    out = H.hierarchies(df, ("path", "descendants"))
    assert out.collect() == [] and out.columns == ["node", "root", "depth", "on_cycle", "descendants", "path"]
    assert H.closure(out).collect() == [] and H.circles(df).collect() == []


def test_closure_and_circles(spark):
    df = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (7, 8), (8, 7), (9, 8)], EDGES)
    assert sorted(map(tuple, H.closure(H.hierarchies(df, ("path",))).collect())) == [(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1)]
    assert sorted(map(tuple, H.circles(df).collect())) == [(7, 8, 7), (8, 7, 7)]


def test_main_parents(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (1, None), (2, 12), (2, 13), (3, None), (4, 20), (4, 21), (None, 1)], "revision_id bigint, parent_id bigint")
    levels = spark.createDataFrame([(10, 5), (11, 9), (13, 0), (20, 3), (21, 3)], "id bigint, level bigint")
    assert {r["node"]: r["parent"] for r in H.main_parents(links, levels).collect()} == {1: 11, 2: 13, 3: None, 4: 20}


def test_paths_of_a_long_chain_come_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(H, "PATH_IDS", 50_000)
    n = 3000
    node = np.arange(2, n + 2)
    got = list(H._walk(node, node - 1, np.ones(n, bool), frozenset({"path", "descendants"})))
    assert max(len(b["path"].flatten()) for b in got) <= 50_000 + n + 1 and sum(len(b["path"].flatten()) for b in got) == n * (n + 3) // 2
    assert sum(b.num_rows for b in got) == n
    last = got[-1].to_pylist()[-1]
    assert last["path"] == list(range(1, n + 2)) and last["depth"] == n and last["descendants"] == 0


def test_a_chain_of_100_000(monkeypatch):
    """Its paths have 5 * 10**9 ids in all, more than an int32 counts; they are given out bit by bit."""
    n = 100_000
    node = np.arange(2, n + 2)
    out = H._walk(node, node - 1, np.ones(n, bool), frozenset({"path"}))
    for b in itertools.islice(out, 5):
        assert b.nbytes < 60 << 20 and all(p[0].as_py() == 1 and len(p) == d.as_py() + 1 for p, d in zip(b["path"], b["depth"], strict=True))


def test_100_000_circles():
    n = 100_000
    node = np.arange(1, 2 * n + 1)
    got = list(H._walk(node, np.where(node % 2 == 1, node + 1, node - 1), np.ones(2 * n, bool), frozenset()))
    assert all((b["depth"].to_numpy() == -1).all() and b["on_cycle"].to_numpy(zero_copy_only=False).all() for b in got)
    assert sum(b.num_rows for b in got) == 2 * n and all(((b["root"].to_numpy() % 2) == 1).all() for b in got)
