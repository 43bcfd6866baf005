"""Nested documents against Python's json, strict."""

import json

from rillstone.operators import nested

DOCS = [
    '[{"positions":[{"log":"a","from":["f",0,1],"to":["f",1,2]}],"ops":[{"daily":{"added":[{"id":1},{"id":"2","count":3,"measures":["m","n"]}],"removed":[{"id":3}]}},{}]}]',
    '{"daily":{"added":[{"id":7,"meta":{"node":"n","tags":[{"k":"x","v":null}]}}],"removed":null}}',
    '[{"ops":[{"daily":{"removed":[{"id":5}]},"affiliates":{"added":[null,{"id":6},4,{"count":1}]}}]},{"daily":{"added":[{"id":8}]}}]',
    '{"positions":[],"ops":null}', "[{}]", "null", "[]", '[{"ops":[null,3,{"daily":5}]}]',
    '[{"ops":[{"daily":{"added":[{"id":1}]}}]}', '[{"daily":{"added":[{"id":1}]}}] x', '[{"daily":{"added":[{"id":NaN}]}}]', "{'daily':{}}", "", "  ", None,
    '{"daily":{"added":[{"id":9}]}}}', '{"daily":{"added":[{"id":9}]}},{"daily":{"added":[{"id":10}]}}', '\t[\n{"daily" : {"added":[ {"id" : 11} ]}} ]\r\n',
    '{"daily":{"added":[{"id":12}]},"daily":{"added":[{"id":13}]}}', '[{"daily":{"added":[{"id":14},]}}]', '[01]',
]


def strict(text):
    def bad(_):
        raise ValueError

    try:
        return [json.loads(text, parse_constant=bad)]
    except (ValueError, TypeError):
        return []


def chunks(text):
    for doc in strict(text):
        for d, e in enumerate(doc if isinstance(doc, list) else [doc]):
            if not isinstance(e, dict):
                continue
            ops = (e.get("ops") or []) if "ops" in e or "positions" in e else [e]
            for o, op in enumerate(ops):
                for name, x in (op.items() if isinstance(op, dict) else ()):
                    for change in ("added", "removed"):
                        for n, c in enumerate((x.get(change) if isinstance(x, dict) else None) or []):
                            if isinstance(c, dict) and c.get("id") is not None:
                                yield d, o, name, change, n, int(c["id"])


def test_chunks(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(DOCS)], "doc int, t string, chunk_id string")
    got = sorted(map(tuple, nested.nested_table(df, "chunks", "t", ["doc"]).collect()))
    assert got == sorted((i, *c) for i, t in enumerate(DOCS) for c in chunks(t))


def test_other_tables(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)], "doc int, t string")
    t = nested.nested_tables(df, "t", ["doc"])
    assert [tuple(r) for r in t["positions"].collect()] == [(0, 0, 0, "a", "f", 0, 1, "f", 1, 2)]
    assert sorted((r["chunk_id"], r["measure_no"], r["measure"]) for r in t["measures"].collect()) == [(2, 0, "m"), (2, 1, "n")]
    assert [(r["chunk_id"], r["tag_no"], r["k"], r["v"]) for r in t["tags"].collect()] == [(7, 0, "x", None)]
    assert sorted((r["doc"], r["diff_no"], r["bare"], r["n_ops"]) for r in t["log_diffs"].collect() if r["doc"] < 5) == [(0, 0, False, 2), (1, 0, True, 1), (2, 0, False, 1), (2, 1, True, 1), (3, 0, False, 0), (4, 0, True, 1)]
    assert {(r["aggregation"], r["n_added"], r["n_removed"]) for r in t["ops"].collect() if r["doc"] == 0} == {("daily", 2, 1)}


def test_empty_and_long(spark):
    assert nested.nested_table(spark.createDataFrame([], "doc int, t string"), "chunks", "t", ["doc"]).collect() == []
    text = json.dumps([{"daily": {"added": [{"id": i} for i in range(20_000)]}}])
    assert nested.nested_table(spark.createDataFrame([(1, text)], "doc int, t string"), "chunks", "t", ["doc"]).count() == 20_000
