"""Applying a feed of inserts, updates, replacements and deletes, column by column.

Pure SQL aggregation in one pass: per field ``max_by`` over the changes that set
it, kept only if it comes after the latest delete (or with or after the latest
replacement). Partial aggregation runs before the shuffle, so a key with a third
of all changes sends one row per task, and repeated deliveries change nothing.

Defined results
    * several changes with equal sequence: a delete comes before a replacement,
      that before an upsert; among equals the greatest value of the field wins.
    * null field: the change doesn't set it. Null key or null sequence: the
      change isn't applied. Null or unknown kind of change: an upsert.
    * repeated rows: as one. Empty feed: no rows, same schema. Extra columns are
      ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE, REPLACE = "delete", "replace"


def apply_changes(changes: DataFrame, keys: list[str], seq: str | Column, op: str | Column, fields: list[str], keep_deleted: bool = False) -> DataFrame:
    """Current rows of the table whose changes are ``changes``.

    ``seq`` orders the changes of a key (any orderable column, a struct too),
    ``op`` is ``delete``, ``replace`` (fields not set become null) or anything
    else for an upsert. Gives ``keys``, ``fields`` and, with ``keep_deleted``,
    a column ``_deleted``.
    """
    seq = F.col(seq) if isinstance(seq, str) else seq
    op = F.col(op) if isinstance(op, str) else op
    rank = F.when(op == DELETE, 0).when(op == REPLACE, 1).otherwise(2)
    own = [F.col(k) for k in keys]
    base = changes.select(*own, *(F.col(f).alias(f"v{i}") for i, f in enumerate(fields)), F.struct(seq.alias("seq"), rank.alias("rank")).alias("at"))
    base = base.where(F.col("at.seq").isNotNull())
    for k in own:
        base = base.where(k.isNotNull())
    aggs = [F.max("at").alias("last"), F.max(F.when(F.col("at.rank") < 2, F.col("at"))).alias("reset")]
    for i in range(len(fields)):
        v = F.when(F.col("at.rank") > 0, F.col(f"v{i}"))  # a delete sets nothing
        order = F.when(v.isNotNull(), F.struct(F.col("at").alias("at"), v.alias("v")))
        aggs.append(F.max_by(F.struct(F.col("at").alias("at"), v.alias("v")), order).alias(f"m{i}"))
    done = base.groupBy(*keys).agg(*aggs)
    alive = F.col("last.rank") > 0
    # A reset is a delete (rank 0) or a replacement (rank 1) that itself sets fields; both come before what has an equal sequence.
    kept = lambda i: F.when(F.col("reset").isNull() | (F.col(f"m{i}.at") >= F.col("reset")), F.col(f"m{i}.v"))
    out = done.select(*keys, *(kept(i).alias(f) for i, f in enumerate(fields)), (~alive).alias("_deleted"))
    return out if keep_deleted else out.where(~F.col("_deleted")).drop("_deleted")


def revision_levels(revisions: DataFrame, backup: DataFrame) -> DataFrame:
    """``id, level``: the greatest known level; rows of type NEW don't know theirs. Null ids have none."""
    known = revisions.where(~F.col("type").eqNullSafe("NEW")).select("id", "level")
    return known.unionByName(backup.select("id", "level")).where(F.col("id").isNotNull() & F.col("level").isNotNull()).groupBy("id").agg(F.max("level").alias("level"))
