"""A mixture of sources by target weights, sized in tokens.

Method: a low-discrepancy schedule. Slot k of the mixture holds the point
frac(k * golden ratio), and the cumulative weights map it to a source, so every
stretch of the mixture has each source in its share. The documents of a source
are shuffled by a hash and cut into blocks of equal tokens; slot and block are
joined by source and rank. A source with too few tokens is gone through again in
another order, at most ``max_repeats`` times; after that its slots stay empty and
the report shows what it fell short of.

Neither the running totals of a source nor its ranks are computed in one task:
both come from totals per bounded bucket, and then within buckets.

Defined results
    * the total is that of all documents with a listed source (equal text). Null
      sources, and sources without documents, get nothing; the weight of a
      source without documents isn't given to others.
    * targets with null source or with null, zero or negative weight are no
      targets; null ``max_repeats`` is 1, one below 1 is 0. A source listed twice
      counts with its greatest weight and repeats.
    * null and empty texts have no tokens and come with the block they fall in.
      Null ids are ignored; repeated ids with equal source count once.
    * empty tables: no rows. A document is never cut: it belongs to the block in
      which it begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm import tokens
from rillstone.scratch import cut

GOLDEN = (math.sqrt(5) - 1) / 2
#: Most tokens of a block, and slots that a mixture has at least for each listed source: so many that rounding to whole
#: slots is under a percent of an average share.
BLOCK_TOKENS = 8192
SLOTS_PER_SOURCE = 400
#: Documents whose running totals one task takes, and slots that it ranks.
PER_BUCKET = 50_000
#: Listed sources; more would be a table of keys rather than a list of targets.
MAX_SOURCES = 10_000


def sizes(docs: DataFrame, targets: DataFrame, vocabulary: str = tokens.VOCABULARY, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents with a listed source."""
    listed = [r["source"] for r in read_targets(targets)]
    own = docs.where(F.col("source").isin(listed) & F.col("doc_id").isNotNull()) if listed else docs.limit(0)
    return tokens.encode(own, keep=("doc_id", "source"), vocabulary=vocabulary, folder=folder, what="n_tokens")


def read_targets(targets: DataFrame) -> list:
    """The targets in order of source, at most MAX_SOURCES of them."""
    ok = targets.where(F.col("source").isNotNull() & (F.col("weight") > 0))
    one = ok.groupBy("source").agg(F.max(F.col("weight").cast("double")).alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("repeats"))
    rows = one.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    return rows


def _running(df: DataFrame, groups: list[str], bucket: str, order: list[str], amount: str, out: str) -> DataFrame:
    """``out``: the sum of ``amount`` over the rows of the group that come before, bucket by bucket."""
    totals = df.groupBy(*groups, bucket).agg(F.sum(amount).alias("__sum"))
    w = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*groups, bucket, F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__in", F.coalesce(F.sum(amount).over(inner), F.lit(0))).join(starts, [*groups, bucket]).withColumn(out, F.col("__start") + F.col("__in")).drop("__start", "__in")


def schedule(spark, slots: int, targets: list) -> DataFrame:
    """``slot, source, rank``: the source of each slot, and how many of its slots came before."""
    total = sum(t["weight"] for t in targets)
    edges = np.cumsum([t["weight"] / total for t in targets])
    sources = pa.array([t["source"] for t in targets], pa.string())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A binary search per slot in the cumulative weights, which are at most MAX_SOURCES numbers."""
        for b in batches:
            slot = b.column(0).to_numpy()
            index = np.minimum(np.searchsorted(edges, np.mod((slot + 1) * GOLDEN, 1.0), "right"), len(edges) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), sources.take(pa.array(index))], names=["slot", "source"])

    placed = spark.range(slots).mapInArrow(place, "slot bigint, source string")
    every = placed.select("slot", "source", F.floor(F.col("slot") / PER_BUCKET).alias("bucket"), F.lit(1).cast("bigint").alias("one"))
    return _running(every, ["source"], "bucket", ["slot"], "one", "rank").select("slot", "source", "rank")


def block_size(whole: int, targets: list, most: int = BLOCK_TOKENS) -> int:
    """Tokens of a block: at most ``most``, fewer where the least target would get fewer than SLOTS_PER_SOURCE slots."""
    least = min(t["weight"] for t in targets) / sum(t["weight"] for t in targets)
    return max(1, min(most, int(whole * max(least, 1 / (len(targets) * 100)) / SLOTS_PER_SOURCE)))


def mix(sized: DataFrame, targets: DataFrame, block_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """``slot, source, doc_id, repeat, n_tokens`` of ``sized`` (of ``sizes``): the mixture in order of slot."""
    spark = sized.sparkSession
    wanted = read_targets(targets)
    kind = sized.schema["doc_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"slot bigint, source string, doc_id {kind}, repeat int, n_tokens bigint")
    one = cut(sized.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens")), "sizes").df
    have = {r["source"]: r for r in one.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}  # as many rows as listed sources
    whole = sum(r["tokens"] for r in have.values())
    if not wanted or not whole:
        return empty
    block_tokens = block_tokens or block_size(whole, wanted)
    slots = math.ceil(whole / block_tokens)
    plan = cut(schedule(spark, slots, wanted), "slots").df
    share = {r["source"]: r["n"] for r in plan.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for t in wanted:
        h, n = have.get(t["source"]), share.get(t["source"], 0)
        if h is not None and h["tokens"] and n:
            rows.append((t["source"], int(min(t["repeats"], math.ceil(n * block_tokens / h["tokens"]))), int(h["tokens"]), n, max(1, math.ceil(h["docs"] / PER_BUCKET))))
    if not rows:
        return empty
    passes = spark.createDataFrame(rows, "source string, passes int, tokens bigint, slots bigint, buckets int")
    every = one.join(F.broadcast(passes), "source")  # one row per listed source
    every = every.where(F.col("passes") > 0).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    # Each pass has its own order; the hash range gives buckets of even size.
    order = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed), F.col("repeat")), 1)
    every = every.withColumn("order", order).withColumn("bucket", F.col("repeat") * F.lit(1 << 32) + F.floor(F.col("order") / F.lit(float(1 << 63)) * F.col("buckets")))
    placed = _running(every, ["source"], "bucket", ["order", "doc_id"], "n_tokens", "start")
    block = F.floor(F.col("start") / block_tokens)
    # The last document comes in if that brings the source nearer to its tokens.
    placed = placed.where((F.col("start") + F.col("n_tokens") / 2 <= F.col("slots") * block_tokens) & (F.col("start") < F.col("slots") * block_tokens)).select("source", "doc_id", "repeat", "n_tokens", block.alias("rank"))
    return placed.join(plan, ["source", "rank"]).select("slot", "source", "doc_id", F.col("repeat").cast("int").alias("repeat"), "n_tokens")


def shares(mixture: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target ``source, weight, target_tokens, tokens, target_share, share, share_of_mix, documents, most_repeats, shortfall``.

    ``share`` is of the total of all documents with a listed source, ``share_of_mix`` of what the mixture has.
    """
    want = targets.where(F.col("source").isNotNull() & (F.col("weight") > 0)).groupBy("source").agg(F.max(F.col("weight").cast("double")).alias("weight"))
    all_weight = want.agg(F.sum("weight")).scalar()
    whole = sized.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("repeat").alias("most_repeats"))
    reached = got.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    every = want.join(got, "source", "left").withColumns({"all_weight": all_weight, "whole": whole, "reached": reached})
    goal = F.col("weight") / F.col("all_weight")
    tokens_ = F.coalesce("tokens", F.lit(0))
    return every.select(
        "source", "weight", F.round(goal * F.col("whole")).cast("bigint").alias("target_tokens"), tokens_.alias("tokens"), goal.alias("target_share"),
        F.when(F.col("whole") > 0, tokens_ / F.col("whole")).otherwise(0.0).alias("share"), F.when(F.col("reached") > 0, tokens_ / F.col("reached")).otherwise(0.0).alias("share_of_mix"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.greatest(F.round(goal * F.col("whole")).cast("bigint") - tokens_, F.lit(0)).alias("shortfall"),
    )
