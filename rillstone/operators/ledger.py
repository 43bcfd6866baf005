"""Processing only new or changed records, once each, whatever fails.

``WorkLedger`` keeps work items with the states pending, leased and done as small
files in a shared folder. Every change of state is the exclusive creation of the
item's next version, so of two writers one wins. The version of a lease is its
fencing token: a writer whose lease ran out and was given to another is rejected.
Outputs lie at a path that depends on the item alone, so a retry of work that was
written but not marked finds it there.

``process_runs`` cuts the successful runs of a processor into items. An item is one
Spark job over the rows loaded since the item before and the versions kept of
earlier ones, written once: its cases and the newest version of each id it touched.
Ids that it doesn't touch aren't written again; every ITEMS_PER_BASE items what was
kept is merged. Of long texts a digest is kept.

Defined results
    * null id: ignored. Null ``loaded_at``: never seen by a run. Null version
      time: ``loaded_at`` stands for it. Null fields are equal to each other.
    * versions with equal time: the one loaded last, then the greatest fields (of
      texts over KEPT_CHARS: by their beginning, then their SHA-256).
    * repeated rows: as one. Runs with equal cutoff: the later run_id gets nothing.
    * runs without cutoff, or with a status other than ``ok``: no run. A run that
      comes with a cutoff before one already worked on gets nothing: its records
      went to that one, and none is given out twice.
    * empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.operators.skew import hot_keys
from rillstone.scratch import filesystem, new_dir
from rillstone.sources import atomic

PENDING, LEASED, DONE = "pending", "leased", "done"


class StaleLease(RuntimeError):
    """The lease's token isn't the newest of its item."""


@dataclass(frozen=True)
class Lease:
    item: str
    token: int
    owner: str
    expires: float
    payload: dict = field(default_factory=dict)


class WorkLedger:
    """Work items under ``root``; see the module. Items are few: one per batch of work, not per record.

    An item's versions are the files ``items/<item>.<version>``, each published
    whole (``atomic.put``), so an item exists from its first version on and a
    writer that dies before that has left nothing. One listing tells all items
    and their newest versions. Names of items sort in the order of the work.
    """

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self._fs, _ = filesystem(spark, self.root)

    def _newest(self) -> dict[str, int]:
        """Item -> newest version, in order of the names."""
        out: dict[str, int] = {}
        for n in atomic.names(self.spark, f"{self.root}/items"):
            item, _, version = n.rpartition(".")
            out[item] = max(out.get(item, 0), int(version))
        return dict(sorted(out.items()))

    def _put(self, item: str, version: int, record: dict) -> bool:
        """Creates version ``version`` of ``item`` unless there is one."""
        return atomic.put(self.spark, f"{self.root}/items", f"{item}.{version:09d}", record)

    def _latest(self, item: str) -> tuple[int, dict]:
        versions = self._newest()
        if item not in versions:
            raise KeyError(item)
        return versions[item], self._read(item, versions[item])

    def _read(self, item: str, version: int) -> dict:
        record = atomic.get(self.spark, f"{self.root}/items/{item}.{version:09d}")
        if record is None:
            raise ValueError(f"{item}: version {version} can't be read")
        return record

    def add(self, item: str, payload: dict | None = None) -> bool:
        """Adds a pending item; False if there is one of this name, which stays as it is."""
        return self._put(item, 0, {"state": PENDING, "payload": payload or {}})

    def items(self) -> list[str]:
        return list(self._newest())

    def payload(self, item: str) -> dict:
        return self._read(item, 0)["payload"]

    def _state(self, record: dict) -> str:
        return PENDING if record["state"] == LEASED and record["expires"] <= self.clock() else record["state"]

    def state(self, item: str) -> str:
        """pending, leased or done; a lease that ran out is pending again."""
        return self._state(self._latest(item)[1])

    def lease(self, owner: str, seconds: float, item: str | None = None) -> Lease | None:
        """Leases ``item``, or the first pending item by name; None if there is none to be had."""
        newest = self._newest()
        for name in [item] if item is not None else self.unfinished(newest):
            if name not in newest:
                raise KeyError(name)
            record = self._read(name, newest[name])
            if self._state(record) != PENDING:
                continue
            version, expires = newest[name] + 1, self.clock() + seconds
            if self._put(name, version, {"state": LEASED, "owner": owner, "expires": expires, "payload": record["payload"]}):
                return Lease(name, version, owner, expires, record["payload"])
        return None

    def check(self, lease: Lease) -> None:
        """Raises StaleLease unless ``lease`` is its item's newest version."""
        version, r = self._latest(lease.item)
        if version != lease.token or r["state"] != LEASED:
            raise StaleLease(f"{lease.item}: token {lease.token} is stale, the newest is {version}")

    def _move(self, lease: Lease, record: dict) -> None:
        self.check(lease)
        if not self._put(lease.item, lease.token + 1, record | {"payload": lease.payload}):
            raise StaleLease(f"{lease.item}: token {lease.token} lost to another writer")

    def renew(self, lease: Lease, seconds: float) -> Lease:
        expires = self.clock() + seconds
        self._move(lease, {"state": LEASED, "owner": lease.owner, "expires": expires})
        return Lease(lease.item, lease.token + 1, lease.owner, expires, lease.payload)

    def release(self, lease: Lease) -> None:
        """Gives the item back."""
        self._move(lease, {"state": PENDING})

    def done(self, lease: Lease) -> None:
        """Marks the item done; only the newest token may."""
        self._move(lease, {"state": DONE, "token": lease.token})

    def finished_upto(self, item: str) -> None:
        """Notes that ``item`` and all before it are done, so that later looks needn't open them."""
        atomic.put(self.spark, f"{self.root}/marks", item, {})

    def unfinished(self, newest: dict[str, int] | None = None) -> list[str]:
        """Items that may not be done: those after the last one noted by ``finished_upto``."""
        mark = (atomic.names(self.spark, f"{self.root}/marks") or [""])[-1]
        return [n for n in (self._newest() if newest is None else newest) if n > mark]

    def output(self, item: str, kind: str = "out") -> str:
        """The item's only output path."""
        return f"{self.root}/{kind}/{item}"

    def has_output(self, item: str, kind: str = "out") -> bool:
        return bool(self._fs.exists(filesystem(self.spark, self.output(item, kind))[1]))

    def publish(self, lease: Lease, df: DataFrame, kind: str = "out") -> str:
        """Writes ``df`` as the item's output, whole or not at all. If it is there already, nothing is written again.

        Of two writers that get here at once one's output takes the path; the other's is deleted.
        """
        final = self.output(lease.item, kind)
        if self.has_output(lease.item, kind):
            return final
        staged = f"{self.root}/tmp/{kind}-{lease.item}-{lease.token}"
        df.write.mode("overwrite").parquet(staged)
        self.check(lease)
        atomic.publish(self.spark, staged, final)
        return final


def _literal(values: list, kind: str):
    return F.expr(f"array({', '.join(f'cast({v!r} as {kind})' for v in values)})")


#: Characters up to which a text is kept as it is; of a longer one its beginning and its digest.
KEPT_CHARS = 64
#: Items after which the versions kept so far are merged into one table.
ITEMS_PER_BASE = 16


def _short(field: T.StructField) -> Column:
    """A value that is equal where the field is equal, of bounded size for texts."""
    c = F.col(f"`{field.name}`")
    if not isinstance(field.dataType, T.StringType):
        return c
    return F.when(F.length(c) <= KEPT_CHARS, c).when(c.isNotNull(), F.concat(F.left(c, F.lit(KEPT_CHARS)), F.sha2(c, 256)))


def _versions(rows: DataFrame, key: str, fields: list[str], when: str, loaded: str, first: str | None, last: str) -> DataFrame:
    """Rows loaded after ``first`` up to ``last`` as ``key, loaded, v``, v ordering the versions of a key."""
    at = F.col(loaded).cast("timestamp_ntz")
    values = F.struct(*(_short(rows.schema[c]).alias(f"f{i}") for i, c in enumerate(fields)))
    rows = rows.where(F.col(key).isNotNull() & (at <= F.lit(last).cast("timestamp_ntz")))
    if first is not None:
        rows = rows.where(at > F.lit(first).cast("timestamp_ntz"))
    return rows.select(F.col(key).alias("id"), at.alias("loaded"), F.struct(F.coalesce(F.col(when).cast("timestamp_ntz"), at).alias("t"), at.alias("loaded"), values.alias("values")).alias("v"))


def changed(state: DataFrame | None, rows: DataFrame, runs: list[tuple[int, str]]) -> DataFrame:
    """``run_id, id, changed, last, v``: per run (run_id, cutoff; in order) and id touched by ``rows``, once.

    ``state`` is ``id, v`` from before (an id may be there several times, its
    greatest ``v`` counts), ``rows`` (``_versions``) what was loaded since.
    ``changed`` marks the cases, ``last`` the state of the id after these runs.
    """
    cutoffs = _literal([c for _, c in runs], "timestamp_ntz")
    ids = F.expr(f"array({', '.join(str(int(r)) for r, _ in runs)})")
    seen = F.size(F.filter(cutoffs, lambda c: c < F.col("loaded")))
    every = rows.select("id", seen.alias("run"), "v")
    if state is not None:
        every = every.unionByName(state.select("id", F.lit(-1).alias("run"), "v"))
    if hot := hot_keys(every, "id"):  # these are brought down to one row a run before they meet
        few = every.where(F.col("id").isin(hot)).groupBy("id", "run").agg(F.max("v").alias("v"))
        every = every.where(~F.col("id").isin(hot)).unionByName(few)
    best = every.repartition("id").groupBy("id", "run").agg(F.max("v").alias("v"))  # one shuffle for this and the window
    order = Window.partitionBy("id").orderBy("run")
    now = best.select("id", "run", F.max("v").over(order).alias("v"))
    told = now.select("id", "run", "v", F.lag("v").over(order).alias("before"), F.lead("run").over(order).isNull().alias("last"))
    case = F.col("before").isNull() | ~F.col("v.values").eqNullSafe(F.col("before.values"))
    out = told.where("run >= 0").select(F.element_at(ids, F.col("run") + 1).cast("bigint").alias("run_id"), "id", case.alias("changed"), "last", "v")
    return out.where(F.col("changed") | F.col("last"))


def successful_runs(runs: DataFrame, after: tuple[str, int] | None = None) -> list[tuple[int, str]]:
    """(run_id, cutoff) of the runs with status ok past ``after`` (cutoff, run_id), by cutoff and run_id. One row per run of a processor: run metadata, not records."""
    at = F.col("cutoff_at").cast("timestamp_ntz")
    ok = runs.where((F.col("status") == "ok") & at.isNotNull() & F.col("run_id").isNotNull())
    if after is not None:
        ok = ok.where(F.struct(at, F.col("run_id").cast("bigint")) > F.struct(F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1]).cast("bigint")))
    rows = ok.select("run_id", at.cast("string").alias("c"), at.alias("at")).distinct().orderBy("at", "run_id").collect()
    return [(r["run_id"], r["c"]) for r in rows]


def _kept(spark: SparkSession, ledger: WorkLedger, before: list[str], schema: T.StructType) -> DataFrame | None:
    """``id, v`` of all items ``before``: the newest merged table there is, and what came after it."""
    bases = [n for n in before if n in set(atomic.names(spark, f"{ledger.root}/base"))]
    since = [n for n in before if not bases or n > bases[-1]]
    parts = [spark.read.schema(schema).parquet(*(ledger.output(n, "step") for n in since)).where("last").select("id", "v")] if since else []
    if bases:
        parts.append(spark.read.schema(T.StructType([schema["id"], schema["v"]])).parquet(ledger.output(bases[-1], "base")))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None


def process_runs(source: DataFrame, runs: DataFrame, key: str, fields: list[str], when: str, loaded: str, root: str | None = None, runs_per_item: int = 24, lease_seconds: float = 3600, owner: str = "processor", fail: Callable[[str, Lease], None] | None = None, only_new: bool = False) -> DataFrame:
    """``run_id, id``: for each successful run the records new or changed since the one before.

    Call it again with the same ``root`` after a failure, or when runs and rows
    were added: done items are not worked on again. ``only_new`` gives what this
    call worked on, else all there is. ``fail`` is called at each step of an item
    (for tests). A last item with fewer than ``runs_per_item`` runs is an item of
    its own name, so later runs start a new one.
    """
    spark = source.sparkSession
    ledger = WorkLedger(spark, root or new_dir(spark, "ledger"))
    names = ledger.items()
    last = ledger.payload(names[-1])["runs"][-1] if names else None
    left = successful_runs(runs, (last[1], last[0]) if last else None)
    for k in range(0, len(left), runs_per_item):
        ledger.add(f"{len(names) + k // runs_per_item:06d}", {"runs": left[k : k + runs_per_item]})
    names = ledger.items()
    step = fail or (lambda _what, _lease: None)
    v = _versions(source.limit(0), key, fields, when, loaded, None, "2000-01-01").schema
    schema = T.StructType([T.StructField("run_id", T.LongType()), v["id"], T.StructField("changed", T.BooleanType()), T.StructField("last", T.BooleanType()), v["v"]])
    worked = []
    for name in ledger.unfinished():
        worked.append(name)
        if ledger.state(name) == DONE:
            ledger.finished_upto(name)
            continue
        lease = ledger.lease(owner, lease_seconds, name)
        if lease is None:
            raise StaleLease(f"{name} is leased by another processor; items build on each other")
        step("leased", lease)
        before = names[: names.index(name)]
        since = ledger.payload(before[-1])["runs"][-1][1] if before else None
        own = [tuple(r) for r in lease.payload["runs"]]
        ledger.publish(lease, changed(_kept(spark, ledger, before, schema), _versions(source, key, fields, when, loaded, since, own[-1][1]), own), "step")
        step("written", lease)
        if len(before) % ITEMS_PER_BASE == ITEMS_PER_BASE - 1:
            ledger.publish(lease, _kept(spark, ledger, [*before, name], schema).groupBy("id").agg(F.max("v").alias("v")), "base")
            step("merged", lease)
        ledger.done(lease)
        step("done", lease)
        ledger.finished_upto(name)
    paths = [ledger.output(n, "step") for n in (worked if only_new else names)]
    if not paths:
        return spark.createDataFrame([], T.StructType([schema["run_id"], schema["id"]]))
    return spark.read.schema(schema).parquet(*paths).where("changed").select("run_id", "id")
