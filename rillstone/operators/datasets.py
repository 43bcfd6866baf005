"""Datasets: partitioned collections with map, filter, sorts, reduces, joins and collects.

Each function takes and gives DataFrames; two-phase aggregation, shuffles and
spilling are Spark's. Reducers are declared as aggregations; only a reducer that
has no expression goes through ``reduce_groups`` in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce as fold

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# ---- sources and sinks


def of(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """Literal rows of any iterable, none for an empty relation."""
    return spark.createDataFrame(list(rows), schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def failing(spark: SparkSession, message: str, schema: str) -> DataFrame:
    """A relation whose reading fails with ``message``."""
    names = spark.createDataFrame([], schema).schema
    return spark.range(1).select(*(F.raise_error(F.lit(message)).cast(f.dataType).alias(f.name) for f in names))


def generate(spark: SparkSession, n: int, **columns: Column) -> DataFrame:
    """``n`` rows of expressions over ``id``."""
    return spark.range(n).select(*(c.alias(k) for k, c in columns.items())) if columns else spark.range(n)


def concat(*parts: DataFrame) -> DataFrame:
    """All rows with ``part`` (the argument's number), so that the order of the parts can be had again."""
    return fold(DataFrame.unionByName, (p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)))


def collect(df: DataFrame) -> Iterator:
    """Rows one partition at a time."""
    return df.toLocalIterator()


def discard(df: DataFrame) -> None:
    """Runs it for its effects."""
    df.write.format("noop").mode("overwrite").save()


def cast_to_sorted(df: DataFrame, *keys: str) -> DataFrame:
    """Fails when read unless each partition is in order of ``keys``; otherwise the rows as they are.

    Nothing is shuffled: neighbours are compared within the partition.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            if len(b):
                own = b[list(keys)]
                both = pd.concat([last, own]) if last is not None else own
                if not pd.MultiIndex.from_frame(both).is_monotonic_increasing:
                    raise ValueError(f"a partition isn't sorted by {keys}")
                last = own.tail(1)
            yield b

    return df.mapInPandas(check, df.schema)


def observe(df: DataFrame, name: str, **aggs: Column) -> tuple[DataFrame, Observation]:
    """The rows, and an observation of their number and ``aggs`` that is there once they were read."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("items"), *(c.alias(k) for k, c in aggs.items())), seen


# ---- rows


def flat_map(df: DataFrame, array: Column, name: str, keep: list[str]) -> DataFrame:
    """A row for each element of ``array``; none for null or empty ones."""
    return df.select(*keep, F.explode(array).alias(name))


def map_rows(df: DataFrame, mapper: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A mapper given as a function from rows to any number of rows, on pandas frames in Arrow batches.

    For mappers that no expression can say. A batch is a bounded number of rows
    of one partition, so a mapper must not look beyond the row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield mapper(b)

    return df.mapInPandas(run, schema)


def until(df: DataFrame, stop: Column, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows before the first (in ``order``) for which ``stop`` is true, in each group of ``by``.

    The place of the first is an aggregate, so no group is put into one task.
    """
    key = F.struct(*order)
    if not by:
        return df.where(F.coalesce(key < df.where(stop).agg(F.min(key)).scalar(), F.lit(True)))
    first = df.where(stop).groupBy(*by).agg(F.min(key).alias("__stop"))
    joined = df.join(first, by, "left")
    return joined.where(F.col("__stop").isNull() | (key < F.col("__stop"))).drop("__stop")


# ---- order


def local_sort(df: DataFrame, *keys: str) -> DataFrame:
    return df.sortWithinPartitions(*keys)


def repartition_sort(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Partitioned by key and sorted in each partition."""
    return (df.repartition(partitions, *keys) if partitions else df.repartition(*keys)).sortWithinPartitions(*keys)


def sort(df: DataFrame, *keys: str | Column, distinct_by: list[str] | None = None) -> DataFrame:
    """A total order; with ``distinct_by`` only the first row of each key."""
    return (first_by(df, distinct_by, list(keys)) if distinct_by else df).orderBy(*keys)


def merge(parts: list[DataFrame], keys: list[str], distinct: bool = False) -> DataFrame:
    """Union in order of ``keys``; ``distinct`` keeps the row of the earliest part for each key."""
    if not distinct:
        return fold(DataFrame.unionByName, parts).orderBy(*keys)
    every = concat(*parts)
    return first_by(every, keys, ["part", *[c for c in every.columns if c not in keys and c != "part"]]).drop("part").orderBy(*keys)


def top(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    return df.orderBy(*keys).limit(n)


# ---- groups


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in ``order``: an aggregate with partial results, not a window, unless ``order`` has descending keys."""
    if all(isinstance(k, str) for k in order):
        rest = [c for c in df.columns if c not in keys]
        lead = [k for k in order if k in rest]
        row = F.struct(*lead, *(c for c in rest if c not in lead))
        return df.groupBy(*keys).agg(F.min(row).alias("__row")).select(*(F.col(k) if k in keys else F.col(f"__row.`{k}`") for k in df.columns))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reduce_by(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Two-phase reduce: partial results before the shuffle, final ones after."""
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items()))


def partial(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Accumulators per partition and key (with ``partition``), to be combined by a later ``reduce_by``."""
    return df.groupBy(F.spark_partition_id().alias("partition"), *keys).agg(*(c.alias(n) for n, c in aggs.items()))


def fold_by(df: DataFrame, keys: list[str], value: Column, start: Column, step: Callable[[Column, Column], Column], name: str, order: Column | None = None) -> DataFrame:
    """Folds the values of each key with a binary operator, in order of ``order`` (else of the values).

    For operators without an aggregate; all values of a key come together, so
    prefer ``reduce_by`` where a key may have many.
    """
    rows = F.array_sort(F.collect_list(F.struct((order if order is not None else value).alias("o"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.aggregate(rows, start, lambda a, x: step(a, x["v"])).alias(name))


def reduce_groups(df: DataFrame, keys: list[str], reducer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A reducer that gives any number of rows per key, on pandas frames."""
    return df.groupBy(*keys).applyInPandas(reducer, schema)


def merge_reduce(parts: list[DataFrame], keys: list[str], **aggs: Column) -> DataFrame:
    """Reduces inputs with different columns by key; what an input lacks is null there."""
    every = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return reduce_by(every, keys, **aggs)


# ---- joins


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", unique_right: list[str] | None = None) -> DataFrame:
    """Equi-join; ``unique_right`` first keeps one right row per key, the least in this order."""
    if unique_right is not None:
        right = first_by(right, [r for _, r in on], unique_right)
    condition = fold(lambda a, b: a & b, (left[a] == right[b] for a, b in on))
    return left.join(right, condition, {"anti": "left_anti", "semi": "left_semi"}.get(how, how))


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], joiner: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A joiner that gives any number of rows for the left and right rows of a key (either may be none), on pandas frames.

    All rows of a key come together: for joiners that no join and expression can say.
    """
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(joiner, schema)


# ---- routing


def shard(df: DataFrame, key: str, n: int) -> DataFrame:
    """With ``shard``: the absolute key modulo ``n``."""
    return df.withColumn("shard", F.pmod(F.abs(F.col(key)), F.lit(n)).cast("int"))


def replicate(df: DataFrame, shards: Column) -> DataFrame:
    """A row for each shard number in the array ``shards``."""
    return df.withColumn("shard", F.explode(shards))


def route(df: DataFrame, **conditions: Column) -> dict[str, DataFrame]:
    """Several outputs of one input; a row may go to any number of them."""
    return {k: df.where(c) for k, c in conditions.items()}


def rendezvous(df: DataFrame, key: Column, partitions: list[str], copies: int = 1, buckets: int = 1024) -> DataFrame:
    """With ``shard``: the ``copies`` partitions of highest weight for the key's bucket (a row each).

    Adding or taking away a partition moves only the keys that it gains or loses.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    weights = F.array(*(F.struct(F.xxhash64(bucket, F.lit(p)).alias("w"), F.lit(p).alias("p")) for p in partitions))
    best = F.slice(F.reverse(F.array_sort(weights)), 1, copies)
    return df.withColumn("shard", F.explode(F.transform(best, lambda x: x["p"])))


def page_rank(pages: DataFrame, iterations: int = 10) -> DataFrame:
    """``page, rank`` of ``page, links`` after undamped steps from 1 for each page; what pages give away is split among their links.

    Each step's ranks are written, so a lost executor costs at most one step.
    """
    from rillstone.scratch import cut

    links = cut(pages.where(F.size("links") > 0), "links").df
    ranks = pages.select("page", F.lit(1.0).alias("rank"))
    before = None
    for _ in range(iterations):
        given = links.join(ranks, "page").select(F.explode("links").alias("page"), (F.col("rank") / F.size("links")).alias("rank"))
        now = cut(given.groupBy("page").agg(F.sum("rank").alias("rank")), "ranks")
        if before is not None:
            before.drop()
        before, ranks = now, now.df
    return ranks
