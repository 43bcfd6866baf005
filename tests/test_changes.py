"""Column-wise last writer wins against a replay in order."""

import random

import pytest
from pyspark.sql import functions as F

from rillstone.operators.changes import apply_changes, revision_levels

SCHEMA = "k bigint, seq bigint, op string, a bigint, b string, extra string"
ORDER = {"delete": 0, "replace": 1}


def replay(rows):
    state = {}
    usable = [r for r in rows if r[0] is not None and r[1] is not None]
    for k, _, op, a, b, _ in sorted(usable, key=lambda r: (r[1], ORDER.get(r[2], 2), (r[3] is not None, r[3] or 0))):
        if op == "delete":
            state.pop(k, None)
            continue
        old = {} if op == "replace" else state.get(k, {})
        state[k] = {"a": a if a is not None else old.get("a"), "b": b if b is not None else old.get("b")}
    return {k: (v["a"], v["b"]) for k, v in state.items()}


@pytest.mark.parametrize("seed", range(3))
def test_replay(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(12), i, rng.choice(["insert", "update", "update", "replace", "delete", None]), rng.choice([None, rng.randrange(9)]), rng.choice([None, "x", "y"]), "e") for i in range(150)]
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    got = apply_changes(spark.createDataFrame(rows, SCHEMA), ["k"], "seq", "op", ["a", "b"])
    assert {r["k"]: (r["a"], r["b"]) for r in got.collect()} == replay(rows)


def test_ties_nulls_and_deletes(spark):
    rows = [(1, 5, "delete", 1, "d", ""), (1, 5, "update", 2, None, ""), (1, 5, "update", 3, None, ""), (None, 1, "insert", 1, "", ""), (2, None, "insert", 1, "", ""), (3, 1, "insert", 1, "q", ""), (3, 2, "delete", 9, "z", ""), (4, 1, "insert", 1, "q", ""), (4, 2, "replace", None, "r", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, apply_changes(df, ["k"], "seq", "op", ["a", "b"]).collect())) == [(1, 3, None), (4, None, "r")]
    kept = apply_changes(df, ["k"], F.struct("seq"), "op", ["b"], keep_deleted=True).where("_deleted").collect()
    assert [r["k"] for r in kept] == [3]


def test_empty(spark):
    out = apply_changes(spark.createDataFrame([], SCHEMA), ["k"], "seq", "op", ["a"])
    assert out.collect() == [] and out.columns == ["k", "a"]


def test_levels(spark):
    r = spark.createDataFrame([(1, 0, "NEW"), (2, 3, "HEAD"), (2, 5, "NEW"), (3, 4, None), (None, 1, "HEAD"), (4, None, "HEAD")], "id bigint, level bigint, type string")
    b = spark.createDataFrame([(2, 4), (5, 1)], "id bigint, level bigint")
    assert {x["id"]: x["level"] for x in revision_levels(r, b).collect()} == {2: 4, 3: 4, 5: 1}
