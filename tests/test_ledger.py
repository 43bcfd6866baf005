"""The ledger's states and tokens, and processing that fails at every step."""

import datetime as dt

import pytest

from rillstone.operators import ledger as L
from rillstone.scratch import filesystem, new_dir
from rillstone.sources import atomic

T0 = dt.datetime(2024, 1, 1)
ROWS = "id bigint, level bigint, snapshot string, type string, timestamp timestamp_ntz, created_by string, loaded_at timestamp_ntz, run_id bigint"
RUNS = "run_id bigint, status string, cutoff_at timestamp_ntz"


def h(n):
    return T0 + dt.timedelta(hours=n)


def test_states_leases_and_fencing(spark):
    now = [0.0]
    w = L.WorkLedger(spark, new_dir(spark, "ledger"), clock=lambda: now[0])
    assert w.add("a", {"x": 1}) and not w.add("a") and w.add("b")
    one = w.lease("p", 10)
    assert one.item == "a" and one.payload == {"x": 1} and w.state("a") == L.LEASED
    assert w.lease("q", 10).item == "b" and w.lease("q", 10) is None
    now[0] = 11
    assert w.state("a") == L.PENDING
    two = w.lease("q", 10, "a")
    assert two.token > one.token
    for stale in (lambda: w.done(one), lambda: w.renew(one, 5), lambda: w.release(one), lambda: w.check(one)):
        with pytest.raises(L.StaleLease):
            stale()
    three = w.renew(two, 100)
    w.done(three)
    assert w.state("a") == L.DONE and w.lease("p", 10, "a") is None
    with pytest.raises(L.StaleLease):
        w.done(three)


def test_publish_once(spark):
    now = [0.0]
    w = L.WorkLedger(spark, new_dir(spark, "ledger"), clock=lambda: now[0])
    w.add("a")
    one = w.lease("p", 10)
    path = w.publish(one, spark.range(3))
    now[0] = 11
    two = w.lease("q", 10)
    assert w.publish(two, spark.range(5)) == path and spark.read.parquet(path).count() == 3
    with pytest.raises(L.StaleLease):
        w.publish(one, spark.range(1), "other")


def data(spark):
    rows = [
        (1, 0, None, "NEW", h(0), "a", h(1), 7), (1, 1, None, "HEAD", h(2), "a", h(3), 7), (1, 0, None, "NEW", h(0), "a", h(5), 7),
        (2, 1, "s", "HEAD", None, None, h(2), 7), (2, 1, "s", "HEAD", None, None, h(2), 7), (2, 1, "s", "HEAD", None, None, h(4), 7),
        (3, 1, None, "HEAD", h(9), "b", h(4), 7), (3, 2, None, "HEAD", h(8), "b", h(6), 7), (None, 1, None, "HEAD", h(1), "b", h(1), 7), (4, 1, None, "HEAD", h(1), "b", None, 7), (5, 1, None, "HEAD", h(1), "b", h(99), 7),
    ]
    runs = [(1, "ok", h(1)), (2, "failed", h(2)), (3, "ok", h(3)), (5, "ok", h(4)), (4, "ok", h(4)), (6, None, h(5)), (7, "ok", h(6)), (8, "ok", None)]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(runs, RUNS)


WANT = [(1, 1), (3, 1), (3, 2), (4, 3)]
ARGS = ("id", ["level", "snapshot", "type", "created_by"], "timestamp", "loaded_at")


@pytest.mark.parametrize("per_item", [1, 2, 24])
def test_runs(spark, per_item):
    source, runs = data(spark)
    got = sorted(map(tuple, L.process_runs(source, runs, *ARGS, runs_per_item=per_item).collect()))
    assert got == WANT


@pytest.mark.parametrize("at", ["leased", "written", "merged", "done"])
def test_failures_skip_and_repeat_nothing(spark, monkeypatch, at):
    source, runs = data(spark)
    monkeypatch.setattr(L, "ITEMS_PER_BASE", 1)
    root, left = new_dir(spark, "ledger"), [2]

    def fail(step, lease):
        if step == at and left[0]:
            left[0] -= 1
            raise RuntimeError("lost")

    for _ in range(3):
        try:
            out = L.process_runs(source, runs, *ARGS, root=root, runs_per_item=2, lease_seconds=0, fail=fail)
            break
        except RuntimeError:
            pass
    assert sorted(map(tuple, out.collect())) == WANT


def test_later_runs_and_rows(spark):
    source, runs = data(spark)
    root = new_dir(spark, "ledger")
    L.process_runs(source, runs.where("run_id < 4"), *ARGS, root=root)
    assert sorted(map(tuple, L.process_runs(source, runs, *ARGS, root=root).collect())) == WANT


def test_empty(spark):
    source, runs = data(spark)
    assert L.process_runs(source.limit(0), runs, *ARGS).collect() == []
    assert L.process_runs(source, runs.limit(0), *ARGS).collect() == []


class Faults:
    """Fails at the ``at``-th publication, before or after it, once."""

    def __init__(self, monkeypatch, at, after):
        self.left, self.after, self.real = at, after, atomic.publish
        monkeypatch.setattr(atomic, "publish", self)

    def __call__(self, *args):
        self.left -= 1
        if not self.left and not self.after:
            raise RuntimeError("lost")
        out = self.real(*args)
        if not self.left:
            raise RuntimeError("lost")
        return out


def test_lost_at_every_publication(spark, monkeypatch):
    """Items, leases, outputs, merged tables, states and marks: a processor lost before or after any of them is followed by one that ends right."""
    source, runs = data(spark)
    source = source.coalesce(1)
    monkeypatch.setattr(L, "ITEMS_PER_BASE", 2)
    real, at = atomic.publish, 0
    while True:
        at += 1
        root, lost = new_dir(spark, "ledger"), True
        faults = Faults(monkeypatch, at, at % 2 == 0)
        try:
            out = L.process_runs(source, runs, *ARGS, root=root, runs_per_item=3, lease_seconds=0)
            lost = False
        except RuntimeError:
            pass
        monkeypatch.setattr(atomic, "publish", real)
        if lost:
            out = L.process_runs(source, runs, *ARGS, root=root, runs_per_item=3, lease_seconds=0)
        assert sorted(map(tuple, out.collect())) == WANT
        if not lost:
            assert faults.left > 0 and at > 10
            break


def test_an_item_never_added_can_be_added(spark):
    w = L.WorkLedger(spark, new_dir(spark, "ledger"))
    fs, p = filesystem(spark, f"{w.root}/items.tmp/a.000000000-lost")
    fs.create(p, False).close()
    assert w.items() == [] and w.add("a") and w.items() == ["a"] and w.state("a") == L.PENDING


def test_two_publishers(spark, monkeypatch):
    """The second finds the path taken: nothing is nested in the first's output."""
    now = [0.0]
    w = L.WorkLedger(spark, new_dir(spark, "ledger"), clock=lambda: now[0])
    w.add("a")
    one = w.lease("p", 10)
    monkeypatch.setattr(w, "has_output", lambda *_: False)
    path = w.publish(one, spark.range(3))
    assert w.publish(one, spark.range(5)) == path
    assert spark.read.option("recursiveFileLookup", "true").parquet(path).count() == 3


def test_done_items_arent_opened(spark, monkeypatch):
    source, runs = data(spark)
    root = new_dir(spark, "ledger")
    L.process_runs(source, runs, *ARGS, root=root, runs_per_item=1)
    opened, real = [], atomic.get
    monkeypatch.setattr(atomic, "get", lambda s, p: opened.append(p) or real(s, p))
    again = L.process_runs(source, runs, *ARGS, root=root, runs_per_item=1, only_new=True)
    assert again.collect() == [] and len(opened) == 1


def test_a_run_that_comes_late_repeats_nothing(spark):
    source, runs = data(spark)
    root = new_dir(spark, "ledger")
    first = sorted(map(tuple, L.process_runs(source, runs.where("run_id <> 3"), *ARGS, root=root).collect()))
    assert sorted(map(tuple, L.process_runs(source, runs, *ARGS, root=root).collect())) == first == [(1, 1), (4, 1), (4, 2), (4, 3)]


def test_long_texts_are_told_apart(spark):
    long = "x" * 5000
    rows = [(1, 1, long + "a", "HEAD", h(0), None, h(1), 7), (1, 1, long + "b", "HEAD", h(2), None, h(3), 7), (1, 1, long + "b", "HEAD", h(3), None, h(4), 7)]
    runs = spark.createDataFrame([(1, "ok", h(1)), (2, "ok", h(3)), (3, "ok", h(4))], RUNS)
    assert sorted(map(tuple, L.process_runs(spark.createDataFrame(rows, ROWS), runs, *ARGS, runs_per_item=1).collect())) == [(1, 1), (2, 1)]


def test_a_hot_id(spark):
    rows = [(1, i % 7, None, "HEAD", h(i % 50), None, h(i % 60), 7) for i in range(3000)] + [(i, 1, None, "HEAD", h(1), None, h(i % 60), 7) for i in range(2, 1500)]
    runs = spark.createDataFrame([(i, "ok", h(10 * i)) for i in range(1, 7)], RUNS)
    source = spark.createDataFrame(rows, ROWS)
    want, before = [], {}
    for i in range(1, 7):
        now: dict = {}
        for r in rows:
            if r[6] <= h(10 * i):
                now[r[0]] = max(now.get(r[0], (h(-1),)), (r[4], r[6], r[1]))
        want += [(i, k) for k, v in now.items() if k not in before or before[k][2] != v[2]]
        before = now
    assert sorted(map(tuple, L.process_runs(source, runs, *ARGS, runs_per_item=4).collect())) == sorted(want)
