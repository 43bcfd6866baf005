"""Log rows into rollups, exactly once: files read, positions and chunks are one commit."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rillstone.functions import predicates as P
from rillstone.sources import logs
from rillstone.sources.rollups import RollupStore

#: One consumer of a log: which rows (any projection or explode), their dimensions and measures, and what is known of them.
Consumer = tuple[Callable[[DataFrame], DataFrame], Mapping[str, Column], Mapping[str, Column | None], P.Predicate | None]


def _parts(store: RollupStore, rows: DataFrame, consumers: list[Consumer]) -> dict[str, DataFrame]:
    """Partial results of all consumers; what several give a rollup is put together."""
    out: dict[str, DataFrame] = {}
    for pick, dims, measures, covers in consumers:
        for name, df in store.cube.consume(pick(rows), dims, measures, covers).items():
            out[name] = df if name not in out else out[name].unionByName(df, allowMissingColumns=True)
    return out


def ingest_log(spark: SparkSession, root: str, store: RollupStore, consumers: list[Consumer], log: str, partitions: list[str] | None = None) -> int | None:
    """Ingests the files that came since the store's state; None if none did. Run again after a failure, it neither skips nor repeats.

    The state keeps the names of the files read, so rows appended to an hour that
    was ingested already, or to one before it, are read too, and what comes
    between listing and reading is left for the next time. The last hour is kept
    as position besides. A state that has the position only (written before files
    were kept) counts the files up to its hour as read.
    """
    state = store.manifest.state()
    before, after, read, paths = {}, {}, {}, []
    for p, files in logs.files(spark, root).items():
        if partitions is not None and p not in partitions:
            continue
        key = f"{log}/{p}"
        at, seen, old = state.positions.get(key), state.files.get(key), []
        if seen is None:
            seen = old = [f for f in files if at is not None and logs.hour_of(f) <= at]
        if not (new := sorted(set(files).difference(seen))):
            continue
        before[key], after[key] = at, max([*([at] if at is not None else []), *map(logs.hour_of, new)])
        read[key] = [*old, *new]
        paths += [files[f] for f in new]
    if not paths:
        return None
    rows = logs.read_files(spark, root, paths)
    return store.ingest(_parts(store, rows, consumers), {k: (before[k], after[k]) for k in after}, read)


def stream_into(stream: DataFrame, store: RollupStore, consumers: list[Consumer], name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A streaming query that ingests each micro-batch in one commit.

    The batch number is committed with the chunks; a batch that comes again
    after a failure finds its number and does nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = store.manifest.state().positions.get(f"stream/{name}", -1)
        if number <= done or df.isEmpty():
            return
        store.ingest(_parts(store, df, consumers), {f"stream/{name}": (done, number)})

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()
