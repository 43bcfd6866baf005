"""Rollups as log-structured Parquet tables: sorted chunks, pruned scans, consolidation, vacuum, backup."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce as fold
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.functions import predicates as P
from rillstone.plans.cube import Cube, Rollup
from rillstone.scratch import filesystem
from rillstone.sources.manifest import Conflict, Diff, Manifest, State

#: Rows of a chunk, chunks consolidated at once, and overlapping chunks from which ingestion should wait.
CHUNK_ROWS, MAX_CHUNKS, MAX_OVERLAP = 1_000_000, 1000, 300


class TooManyOverlaps(RuntimeError):
    """Consolidate before ingesting more."""


def _plain(v: Any) -> Any:
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


class RollupStore:
    """The rollups of a cube under ``root``, with one manifest for all."""

    def __init__(self, spark: SparkSession, root: str, cube: Cube, chunk_rows: int = CHUNK_ROWS, max_overlap: int = MAX_OVERLAP):
        self.spark, self.root, self.cube, self.chunk_rows, self.max_overlap = spark, root.rstrip("/"), cube, chunk_rows, max_overlap
        self.manifest = Manifest(spark, self.root)
        self._fs, _ = filesystem(spark, self.root)
        self._pinned: State | None = None
        cube.pins.append(self.pinned)
        for r in cube.rollups.values():
            cube.attach(r.name, lambda where, measures, r=r: self.scan(r.name, where, measures), lambda where, measures, r=r: len(self.find(r.name, where, measures)))

    @contextmanager
    def pinned(self) -> Iterator[None]:
        """Within it all reads see one state, read from storage once."""
        if self._pinned is not None:
            yield
            return
        self._pinned = self.manifest.state()
        try:
            yield
        finally:
            self._pinned = None

    def _state(self) -> State:
        return self._pinned or self.manifest.state()

    # ---- writing

    def _write(self, r: Rollup, df: DataFrame) -> dict[str, Any]:
        """Writes partial results as chunks sorted by key; their manifest entries."""
        measures = [m for m in r.measures if m in df.columns]
        path = f"{self.root}/data/{r.name}/{uuid.uuid4().hex}"
        kept = df.select(*r.dims, *measures)
        rows = (kept.repartitionByRange(*r.dims) if r.dims else kept.coalesce(1)).sortWithinPartitions(*r.dims)
        parts = [f"__part_{d}" for d in r.partition_by]
        rows.withColumns({p: F.col(d) for p, d in zip(parts, r.partition_by, strict=True)}).write.option("maxRecordsPerFile", self.chunk_rows).partitionBy(*parts).parquet(path)
        back = self.spark.read.schema(kept.schema).parquet(path)
        own = F.struct(*r.dims) if r.dims else F.lit(0)
        stats = back.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("low"), F.max(own).alias("high"), *(f(d).alias(f"{w}_{d}") for d in r.dims for w, f in (("min", F.min), ("max", F.max)))).collect()  # one row a chunk
        out = {}
        for s in stats:
            ends = lambda k, s=s: [_plain(s[k][d]) for d in r.dims] if r.dims else []
            out[s["file"]] = {"measures": measures, "count": s["n"], "min": ends("low"), "max": ends("high"), "ranges": {d: [_plain(s[f"min_{d}"]), _plain(s[f"max_{d}"])] for d in r.dims}, "at": time.time()}
        return out

    def ingest(self, parts: dict[str, DataFrame], positions: dict[str, tuple[Any, Any]] | None = None, read: dict[str, list[str]] | None = None) -> int:
        """Adds partial results (of ``Cube.consume``), log positions and files read in one commit; its version.

        A reader sees all of it or nothing. Raises TooManyOverlaps, and Conflict for files read already, before writing.
        """
        state = self.manifest.state()
        for log, names in (read or {}).items():
            if state.files.get(log, set()).intersection(names):
                raise Conflict(f"{log} was read further meanwhile")
        for name in parts:
            if (n := self.overlap(name, state)) > self.max_overlap:
                raise TooManyOverlaps(f"{name}: {n} chunks overlap")
        added = {name: self._write(self.cube.rollups[name], df) for name, df in parts.items()}
        return self.manifest.commit(Diff({k: v for k, v in added.items() if v}, {}, positions or {}, read or {}), state.version)

    # ---- reading

    def _schema(self, r: Rollup) -> T.StructType:
        """Dimensions and partial results as stored."""
        row = self.spark.range(0).select(*(F.lit(None).cast(self.cube.dims[d]).alias(d) for d in r.dims), F.lit(None).cast("double").alias("__x"))
        kinds = {}
        for m in r.measures:
            measure = self.cube.measures[m]
            kinds[m] = row.agg(measure.partial(F.lit(None).cast(getattr(measure, "kind", "bigint"))).alias(m)).schema[0]
        return T.StructType([*(row.schema[d] for d in r.dims), *kinds.values()])

    def find(self, name: str, where: P.Predicate, measures: Iterable[str], state: State | None = None) -> list[str]:
        """Chunks that may hold rows of ``where`` and one of ``measures``: by the ranges of their dimensions."""
        chunks = (state or self._state()).chunks.get(name, {})
        wanted = set(measures)
        where = where.simplify()
        if where == P.always_false():
            return []
        parts = where.parts if isinstance(where, P.And) else [where]
        out = []
        for file, c in chunks.items():
            if wanted and not wanted & set(c["measures"]):
                continue
            if all(self._may(p, c["ranges"]) for p in parts):
                out.append(file)
        return sorted(out)

    def _may(self, p: P.Predicate, ranges: dict[str, list]) -> bool:
        key = getattr(p, "key", None)
        low, high = ranges.get(key, (None, None))
        if key is None or low is None or high is None or not isinstance(p, (P.Compare, P.Between, P.In)):
            return True
        plain = lambda v: _plain(v)
        try:
            if isinstance(p, P.Between):
                return plain(p.low) <= high and plain(p.high) >= low
            if isinstance(p, P.In):
                return any(v is None or low <= plain(v) <= high for v in p.values)
            v = plain(p.value)
            return v is None or {"=": lambda: low <= v <= high, "<>": lambda: True, "<": lambda: low < v, "<=": lambda: low <= v, ">": lambda: high > v, ">=": lambda: high >= v}[p.op]()
        except TypeError:
            return True

    def _read(self, chunks: dict[str, Any], files: list[str]) -> DataFrame:
        """Rows of the chunks: one reader for all that have the same measures."""
        by: dict[tuple[str, ...], list[str]] = {}
        for f in files:
            by.setdefault(tuple(chunks[f]["measures"]), []).append(f)
        parts = [self.spark.read.parquet(*own) for own in by.values()]
        return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def scan(self, name: str, where: P.Predicate, measures: Iterable[str]) -> DataFrame:
        """Rows of the chunks found; a measure that a chunk doesn't have is null there."""
        r = self.cube.rollups[name]
        state = self._state()
        files = self.find(name, where, measures, state)
        if not files:
            return self.spark.createDataFrame([], self._schema(r))
        out = self._read(state.chunks[name], files)
        for m in measures:
            if m not in out.columns:
                out = out.withColumn(m, F.lit(None))
        return out

    # ---- upkeep

    def overlap(self, name: str, state: State | None = None) -> int:
        """The most chunks whose key ranges hold one key."""
        chunks = (state or self._state()).chunks.get(name, {})
        if not self.cube.rollups[name].dims:
            return len(chunks)
        marks = sorted([(self._order(c["min"]), 0) for c in chunks.values()] + [(self._order(c["max"]), 1) for c in chunks.values()])
        now = most = 0
        for _, end in marks:
            now += -1 if end else 1
            most = max(most, now)
        return most

    @staticmethod
    def _order(key: list) -> list:
        return [("", "") if v is None else (type(v).__name__, v) for v in key]

    def segments(self, name: str) -> list[tuple[list, int]]:
        """Start keys of segments and how many chunks overlap from there, for a look at the table."""
        chunks = self._state().chunks.get(name, {})
        low = sorted(self._order(c["min"]) for c in chunks.values())
        high = sorted(self._order(c["max"]) for c in chunks.values())
        starts = {tuple(map(str, c["min"])): self._order(c["min"]) for c in chunks.values()}
        return [(list(s), bisect_right(low, k) - bisect_left(high, k)) for s, k in sorted(starts.items())]

    def choose(self, name: str, strategy: str = "hot", max_chunks: int = MAX_CHUNKS, state: State | None = None) -> list[str]:
        """Chunks to consolidate.

        ``hot``: those over the most overlapped key. ``min_key``: the first, in
        order of keys, that hold several values of the rollup's partition keys (its
        partitioning changed since); else the first that overlap; else the first
        neighbours of one partition that together are at most one full chunk.
        Either is widened by overlapping neighbours until stable, then cut to
        ``max_chunks`` from the least key.
        """
        chunks = (state or self._state()).chunks.get(name, {})
        split = self.cube.rollups[name].partition_by
        items = sorted(((self._order(c["min"]), self._order(c["max"]), k, c["count"]) for k, c in chunks.items()), key=lambda x: (x[0], x[1], x[2]))
        low, high = [x[0] for x in items], sorted(x[1] for x in items)
        depth = lambda key: bisect_right(low, key) - bisect_left(high, key)
        over = lambda key: [x for x in items[: bisect_right(low, key)] if key <= x[1]]
        of = lambda x: [chunks[x[2]]["ranges"][d] for d in split]
        spanning = [x for x in items if any(a != b for a, b in of(x))] if strategy == "min_key" else []
        picked: list = []
        if spanning:
            picked = spanning[:1]
        elif strategy == "hot":
            hot = max(low, key=depth, default=None)
            picked = over(hot) if hot is not None and depth(hot) > 1 else []
        elif (first := next((k for k in low if depth(k) > 1), None)) is not None:
            picked = over(first)
        else:
            for i, x in enumerate(items):
                total, j = x[3], i + 1
                while j < len(items) and of(items[j]) == of(x) and total + items[j][3] <= self.chunk_rows:
                    total, j = total + items[j][3], j + 1
                if j > i + 1:
                    picked = items[i:j]
                    break
        if len(picked) < (1 if spanning else 2):
            return []
        while True:
            a, b = min(x[0] for x in picked), max(x[1] for x in picked)
            wider = [x for x in items[: bisect_right(low, b)] if x[1] >= a]
            if len(wider) == len(picked):
                break
            picked = wider
        return [x[2] for x in sorted(picked)[:max_chunks]]

    def consolidate(self, name: str, strategy: str = "hot", max_chunks: int = MAX_CHUNKS) -> bool:
        """Merges the chunks chosen into new ones; measures the cube no longer has are left behind. False if there was nothing to do."""
        state = self.manifest.state()
        files = self.choose(name, strategy, max_chunks, state)
        if not files:
            return False
        r = self.cube.rollups[name]
        rows = self._read(state.chunks[name], files)
        own = [m for m in r.measures if m in rows.columns]
        merged = rows.groupBy(*r.dims).agg(*(self.cube.measures[m].merge(F.col(m)).alias(m) for m in own))
        old = state.chunks[name]
        self.manifest.commit(Diff({name: self._write(r, merged)}, {name: {f: old[f] for f in files}}), state.version)
        return True

    def upkeep(self, runs: int = 10) -> int:
        """Consolidates all rollups, hot segment and least key in turn, until nothing is left to do or ``runs`` a rollup are over; the number done."""
        done = 0
        for name in self.cube.rollups:
            for i in range(runs):
                if not (self.consolidate(name, ("hot", "min_key")[i % 2]) or self.consolidate(name, ("min_key", "hot")[i % 2])):
                    break
                done += 1
        return done

    def _files(self) -> list:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        if not self._fs.exists(p):
            return []
        walk, out = self._fs.listFiles(p, True), []
        while walk.hasNext():
            out.append(walk.next())
        return [s for s in out if s.getPath().getName().endswith(".parquet")]

    @staticmethod
    def _tail(path: str) -> str:
        return path[path.index("/data/") :]

    def missing(self) -> set[str]:
        """Chunks of the state whose files aren't there."""
        there = {self._tail(s.getPath().toString()) for s in self._files()}
        return {f for c in self.manifest.state().chunks.values() for f in c if self._tail(f) not in there}

    def vacuum(self, older_than: float) -> int:
        """Deletes files that no chunk of the state uses and that are older than ``older_than`` seconds; snapshots and drops old commits first."""
        self.manifest.snapshot()
        self.manifest.forget()
        used = {self._tail(f) for c in self.manifest.state().chunks.values() for f in c}
        gone = [s for s in self._files() if self._tail(s.getPath().toString()) not in used and s.getModificationTime() / 1000 <= time.time() - older_than]
        for s in gone:
            self._fs.delete(s.getPath(), False)
        return len(gone)

    def backup(self, to: str) -> int:
        """Copies the chunks in use and a snapshot of the state; the version copied."""
        state = self.manifest.state()
        jvm = self.spark.sparkContext._jvm
        path, conf = jvm.org.apache.hadoop.fs.Path, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, _ = filesystem(self.spark, to)
        chunks: dict[str, dict] = {}
        for name, own in state.chunks.items():
            for f, c in own.items():
                target = f"{to.rstrip('/')}{self._tail(f)}"
                jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, path(f), fs, path(target), False, conf)
                chunks.setdefault(name, {})[target] = c
        copy = Manifest(self.spark, to)
        copy._create(f"{state.version:012d}.snapshot", state.to_json() | {"chunks": chunks})
        return state.version
