"""References to records that do not exist, and what depends on them.

``references`` gives the direct orphans with their reason; ``cascade`` follows the
foreign keys down: whoever refers to a record that holds an orphaned reference is
indirectly orphaned, and so on to the fixpoint.

Each round is a semi-join of the links with the records orphaned in the round
before; round 0 are the direct orphans themselves, so one result holds both. A history may be thousands of links deep, so the links are cut into
ranges, and a task that gets newly orphaned records follows them as far as its
own range of links goes; rounds count the changes of range along a history, not
its length. A range is a bounded number of links, also where one record holds a
third of them.

Defined results
    * null parent: no reference, shown as 0. Null key of a record: its links are
      ignored. Repeated links: one, with its first time.
    * null times: a link without any time has period null and is never late; a
      key without ``loaded_at`` is neither deleted nor late.
    * circular references are orphaned if a link leads into them from an orphan.
    * empty tables: no rows (no keys at all: every reference is missing).
"""

from __future__ import annotations

import math
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.operators.skew import lookup
from rillstone.scratch import cut

#: Links a task follows at once.
LINKS_PER_RANGE = 200_000


def key_times(records: DataFrame, deletions: DataFrame, kept: DataFrame) -> DataFrame:
    """``key, first_loaded, last_loaded, last_cleaned, kept, there``: one row per key of three tables, in one shuffle.

    ``records``: ``id, loaded_at``; ``deletions``: ``revision_id, cleaned_at``; ``kept``: ``id``.
    """
    none = F.lit(None).cast("timestamp_ntz")
    a = records.select(F.col("id").alias("key"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded"), none.alias("cleaned"), F.lit(True).alias("there"), F.lit(False).alias("kept"))
    b = deletions.select(F.col("revision_id").alias("key"), none.alias("loaded"), F.col("cleaned_at").cast("timestamp_ntz").alias("cleaned"), F.lit(False).alias("there"), F.lit(False).alias("kept"))
    c = kept.select(F.col("id").alias("key"), none.alias("loaded"), none.alias("cleaned"), F.lit(False).alias("there"), F.lit(True).alias("kept"))
    every = a.unionByName(b).unionByName(c).where(F.col("key").isNotNull())
    return every.groupBy("key").agg(F.min("loaded").alias("first_loaded"), F.max("loaded").alias("last_loaded"), F.max("cleaned").alias("last_cleaned"), F.max("kept").alias("kept"), F.max("there").alias("there"))


def distinct_links(feed: DataFrame) -> DataFrame:
    """``revision_id, parent_id, t`` of a feed with ``revision_id, parent_id, received_at``; null parents as 0."""
    f = feed.where(F.col("revision_id").isNotNull())
    return f.groupBy("revision_id", F.coalesce("parent_id", F.lit(0)).cast("bigint").alias("parent_id")).agg(F.min(F.col("received_at").cast("timestamp_ntz")).alias("t"))


def references(links: DataFrame, keys: DataFrame) -> DataFrame:
    """Direct orphans: ``ref_column, revision_id, parent_id, reason, period`` for ``links`` (of ``distinct_links``) and ``keys`` (of ``key_times``).

    ``missing``: no record; ``deleted``: cleaned after it was last loaded;
    ``late``: first loaded after the link came. Kept keys are never orphans.
    """
    both = links.select("revision_id", "parent_id", "t", F.explode(F.when(F.col("parent_id") != 0, F.array(F.lit("revision_id"), F.lit("parent_id"))).otherwise(F.array(F.lit("revision_id")))).alias("ref_column"))
    both = both.withColumn("key", F.when(F.col("ref_column") == "parent_id", F.col("parent_id")).otherwise(F.col("revision_id")))
    found = lookup(both, keys, "key", ["revision_id"])
    reason = (
        F.when(~F.coalesce("there", F.lit(False)), "missing")
        .when(F.col("last_loaded") < F.col("last_cleaned"), "deleted")
        .when(F.col("first_loaded") > F.col("t"), "late")
    )
    out = found.where(~F.coalesce("kept", F.lit(False))).select("ref_column", "revision_id", "parent_id", reason.alias("reason"), F.date_format("t", "yyyy-MM").alias("period"))
    return out.where(F.col("reason").isNotNull())


#: Kinds of rows that a range's task gets.
_LINK, _SEED, _HIT = 0, 1, 2


def _follow(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Records of one range that newly orphaned ones (seeds) reach within it, those hit before left out."""
    kind = rows["kind"].to_numpy()
    child, parent = rows["child"].to_numpy(np.int64), rows["parent"].to_numpy(np.int64)
    link, part = kind == _LINK, rows["part"].iloc[0]
    ids, inverse = np.unique(np.concatenate([child[link], parent[link], parent[kind == _SEED], child[kind == _HIT]]), return_inverse=True)
    n, m = int(link.sum()), int((kind == _SEED).sum())
    c, p, s, before = inverse[:n], inverse[n : 2 * n], inverse[2 * n : 2 * n + m], inverse[2 * n + m :]
    order = np.argsort(p, kind="stable")
    c, first = c[order], np.searchsorted(p[order], np.arange(len(ids) + 1))
    hit, front = np.zeros(len(ids), bool), np.unique(s)
    hit[before] = True
    new = np.zeros(len(ids), bool)
    while len(front):
        counts = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        nxt = np.unique(c[at])
        front = nxt[~hit[nxt]]
        hit[front] = new[front] = True
    return pd.DataFrame({"part": np.int32(part), "node": ids[new]})


def cascade(links: DataFrame, direct: DataFrame) -> DataFrame:
    """``round, revision_id`` and ``direct``'s other columns: the fixpoint of orphaned records over ``links``.

    Round 0 are the rows of ``direct`` as they are, whose ``revision_id`` holds an
    orphaned reference; later rounds have one row (other columns null) for each
    other record, in the first round in which it refers to one orphaned before.

    A range of links keeps what was reached in it, in a folder of its own, so a
    round reads the ranges that it gets to and no others, and nothing is compared
    with all records orphaned so far.
    """
    real = links.where(F.col("parent_id") != 0).select(F.col("revision_id").alias("child"), F.col("parent_id").alias("parent"))
    known = cut(direct, "orphans")
    parts = max(1, math.ceil(links.count() / LINKS_PER_RANGE))
    # A range of (child, parent): also the links of one child may lie in several.
    ranged = cut(real.repartitionByRange(parts, "child", "parent").withColumn("part", F.spark_partition_id()), "links", ("part",))
    ports = cut(ranged.df.select("parent", "part").distinct().repartitionByRange("parent").sortWithinPartitions("parent"), "ports")
    row = lambda df, kind, child, parent: df.select("part", F.lit(kind).alias("kind"), child.cast("bigint").alias("child"), parent.cast("bigint").alias("parent"))
    none = F.lit(0)
    front, rounds = known.df.select(F.col("revision_id").alias("node")), []
    while True:
        ends = front.agg(F.min("node").alias("a"), F.max("node").alias("b"))
        near = ports.df.where(F.col("parent").between(*ends.first())) if rounds else ports.df  # sorted: other row groups aren't read
        given = cut(near.join(front.select(F.col("node").alias("parent")), "parent", "left_semi"), "given")
        active = [r["part"] for r in given.df.select("part").distinct().collect()]  # numbers of ranges, not records
        if not active:
            given.drop()
            break
        here = F.col("part").isin(active)
        rows = row(ranged.df.where(here), _LINK, F.col("child"), F.col("parent")).unionByName(row(given.df, _SEED, none, F.col("parent")))
        for x in rounds:
            rows = rows.unionByName(row(x.df.where(here), _HIT, F.col("node"), none))
        new = cut(rows.groupBy("part").applyInPandas(_follow, "part int, node bigint"), "orphans", ("part",))
        given.drop()
        if new.df.isEmpty():
            new.drop()
            break
        rounds.append(new)
        front = new.df.select("node")
    for x in (ranged, ports):
        x.drop()
    out = known.df.withColumn("round", F.lit(0))
    if not rounds:
        return out
    reached = [x.df.select(F.col("node").alias("revision_id"), F.lit(k).alias("round")) for k, x in enumerate(rounds, 1)]
    later = fold(DataFrame.unionByName, reached).groupBy("revision_id").agg(F.min("round").alias("round"))
    later = later.join(known.df.select("revision_id"), "revision_id", "left_anti")
    return out.unionByName(later, allowMissingColumns=True)


def orphan_report(feed: DataFrame, records: DataFrame, deletions: DataFrame, kept: DataFrame) -> DataFrame:
    """``kind, ref_column, revision_id, parent_id, reason, period``: what the cascade from the orphaned references comes to.

    Direct are those of its round 0. Inherited is a link whose parent record was
    orphaned in any round (reason ``inherited``, ref_column ``parent_id``) while
    that reference itself is none.
    """
    links = cut(distinct_links(feed), "links")
    state = cascade(links.df, references(links.df, key_times(records, deletions, kept)))
    direct = state.where("round = 0").drop("round")
    own = direct.where(F.col("ref_column") == "parent_id").select("revision_id", "parent_id")
    below = links.df.where(F.col("parent_id") != 0).join(own, ["revision_id", "parent_id"], "left_anti")
    marks = state.groupBy(F.col("revision_id").alias("parent_id")).agg(F.lit(True).alias("bad"))
    inherited = lookup(below, marks, "parent_id", ["revision_id"]).where("bad")
    inherited = inherited.select(F.lit("inherited").alias("kind"), F.lit("parent_id").alias("ref_column"), "revision_id", "parent_id", F.lit("inherited").alias("reason"), F.date_format("t", "yyyy-MM").alias("period"))
    return direct.select(F.lit("direct").alias("kind"), "ref_column", "revision_id", "parent_id", "reason", "period").unionByName(inherited)


def orphan_counts(report: DataFrame) -> DataFrame:
    """``kind, ref_column, reason, period, n``: a report counted per column and month."""
    return report.groupBy("kind", "ref_column", "reason", "period").agg(F.count(F.lit(1)).alias("n"))
