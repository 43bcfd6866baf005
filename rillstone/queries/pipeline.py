"""Queries p1 to p5 over the commit tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators import changes, hierarchy, ledger, nested, orphans
from rillstone.operators.skew import hot_keys, lookup
from rillstone.queries.pipeline_sql import ORACLE
from rillstone.scratch import new_dir


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return changes.revision_levels(table(spark, d, "revisions"), table(spark, d, "revisions_backup"))


def _forest(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.main_parents(table(spark, d, "diffs"), _levels(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of each revision."""
    tree = hierarchy.hierarchies(_forest(spark, d))
    return tree.select(F.col("node").alias("revision_id"), F.col("root").alias("root_id"), "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path and number of descendants of each revision."""
    tree = hierarchy.hierarchies(_forest(spark, d), want=("path", "descendants"))
    return tree.select(F.col("node").alias("revision_id"), "path", "descendants")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of each revision, as rows."""
    tree = hierarchy.hierarchies(_forest(spark, d), want=("path",))
    return hierarchy.closure(tree)


def p1_paths_all(spark: SparkSession, d: str) -> DataFrame:
    """Path and number of descendants of each revision, also where its way ends in a circle."""
    tree = hierarchy.whole_paths(_forest(spark, d))
    return tree.select(F.col("node").alias("revision_id"), "path", "descendants", F.col("circle").alias("circle_id"))


def p1_descendants_all(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of each revision, as rows, also on and below circles."""
    return hierarchy.whole_closure(_forest(spark, d))


def p1_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The links of circular histories."""
    c = hierarchy.circles(_forest(spark, d))
    return c.select(F.col("node").alias("revision_id"), F.col("parent").alias("parent_id"), F.col("circle").alias("circle_id"))


def _chunk_changes(spark: SparkSession, d: str, fields: tuple[str, ...]) -> DataFrame:
    """Chunk changes of all links with their order, levels attached."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    feed = table(spark, d, "diffs").where(F.col("revision_id").isNotNull() & F.col("diff").isNotNull())
    # Changes stay packed in one array per link until the level is known: a link goes through the shuffles, not each of its changes.
    packed = feed.select("revision_id", F.coalesce("parent_id", F.lit(0)).cast("bigint").alias("parent_id"), nested._rows("chunks", nested.log_diffs(F.col("diff"), fields), fields, "meta" in fields).alias("changes"))
    levels = _levels(spark, d)
    own = lookup(packed, levels.select(F.col("id").alias("revision_id"), F.col("level").alias("own")), "revision_id", ["parent_id"], hot_links(spark, d, "revision_id"))
    asked = own.withColumn("ask", F.when(F.col("own").isNull(), F.col("parent_id")))
    both = lookup(asked, levels.withColumnRenamed("id", "ask"), "ask", ["revision_id", "parent_id"], hot_links(spark, d, "parent_id"))
    level = F.coalesce("own", F.col("level") + 1)
    # No condition on the array itself, stated or inferred: it would be pushed down and each document parsed twice.
    return both.select("revision_id", "parent_id", level.alias("at_level"), F.inline(F.when(level.isNotNull(), F.col("changes"))))


def hot_links(spark: SparkSession, d: str, key: str) -> list:
    """Revisions or parents with many links: counted on that column alone."""
    return hot_keys(table(spark, d, "diffs").select(key), key)


_SEQ = ("at_level", "revision_id", "parent_id", "diff_no", "op_no")


def _alive(spark: SparkSession, d: str, fields: tuple[str, ...]) -> DataFrame:
    c = _chunk_changes(spark, d, fields)
    seq = F.struct(*_SEQ, F.when(F.col("change") == "removed", 0).otherwise(1).alias("added"))
    op = F.when(F.col("change") == "removed", changes.DELETE).otherwise("upsert")
    values = ["revision_id", *(f for f in fields if f not in ("id", "meta")), *(("node", "tags") if "meta" in fields else ())]
    c = c.withColumn("last_revision", F.col("revision_id"))
    return changes.apply_changes(c, ["chunk_id"], seq, op, ["last_revision", *values[1:]]).withColumnRenamed("last_revision", "revision_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks alive after all changes, with the revision of their last change."""
    return _alive(spark, d, ("id",)).select("chunk_id", "revision_id")


def p2_state(spark: SparkSession, d: str) -> DataFrame:
    """The table of chunks alive, each field by its last change that set it."""
    s = _alive(spark, d, ("id", "min", "max", "count"))
    return s.select("chunk_id", "revision_id", F.array_join("min", "|").alias("min_key"), F.array_join("max", "|").alias("max_key"), F.col("count").alias("n_rows"))


def p2_state_all(spark: SparkSession, d: str) -> DataFrame:
    """The table of chunks alive with every field; tags by their keys and values, in order."""
    s = _alive(spark, d, tuple(nested.CHUNK_FIELDS))
    return s.select(
        "chunk_id", "revision_id", F.array_join("min", "|").alias("min_key"), F.array_join("max", "|").alias("max_key"), F.col("count").alias("n_rows"),
        "measures", "node", F.col("tags.k").alias("tag_keys"), F.col("tags.v").alias("tag_values"),
    )


def _documents(spark: SparkSession, d: str) -> list[tuple[DataFrame, str]]:
    feed = table(spark, d, "diffs").select(F.lit("diff").alias("holder"), "revision_id", F.coalesce("parent_id", F.lit(0)).cast("bigint").alias("parent_id"), F.col("diff").alias("doc"))
    held = table(spark, d, "revisions").select(F.lit("snapshot").alias("holder"), F.col("id").alias("revision_id"), F.lit(0).cast("bigint").alias("parent_id"), F.col("snapshot").alias("doc"))
    return [(feed, "doc"), (held, "doc")]


def _nested(spark: SparkSession, d: str, name: str) -> DataFrame:
    parts = [nested.nested_table(df, name, text, ["holder", "revision_id", "parent_id"]) for df, text in _documents(spark, d)]
    return parts[0].unionByName(parts[1]).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each chunk entry of the diffs and snapshots."""
    return _nested(spark, d, "chunks")


def p3_positions(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d, "positions")


def p3_log_diffs(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d, "log_diffs")


def p3_ops(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d, "ops")


def p3_measures(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d, "measures")


def p3_tags(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d, "tags")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Per successful run the revisions new or changed since the one before, through the ledger."""
    return ledger.process_runs(table(spark, d, "revisions"), table(spark, d, "processor_runs"), "id", ["level", "snapshot", "type", "created_by"], "timestamp", "loaded_at")


def p4_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same in three calls on one ledger: with the runs of the first half, then one that is lost after its output is written, then to the end."""
    source, runs, root = table(spark, d, "revisions"), table(spark, d, "processor_runs"), new_dir(spark, "ledger")
    args = (source, "id", ["level", "snapshot", "type", "created_by"], "timestamp", "loaded_at", root)
    call = lambda of, **more: ledger.process_runs(args[0], of, *args[1:], runs_per_item=12, **more)
    half = ledger.successful_runs(runs)
    call(runs.where(F.col("cutoff_at").cast("timestamp_ntz") <= F.lit(half[len(half) // 2][1]).cast("timestamp_ntz")) if half else runs)

    def lost(step, _lease):
        if step == "written":
            raise ConnectionError("lost")

    try:
        call(runs, fail=lost, lease_seconds=0)
    except ConnectionError:
        pass
    return call(runs)


def _report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(table(spark, d, "diffs"), table(spark, d, "revisions"), table(spark, d, "cleanup_log"), table(spark, d, "revisions_backup"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose key is missing, deleted or late: the direct rows of the report."""
    return _report(spark, d).where(F.col("kind") == "direct").select("ref_column", "revision_id", "parent_id", "reason", "period")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans counted per column and month."""
    return orphans.orphan_counts(_report(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_paths_all, p1_descendants_all, p1_cycles, p2_found, p2_state, p2_state_all, p3_found, p3_positions, p3_log_diffs, p3_ops, p3_measures, p3_tags, p4_found, p4_resumed, p5_found, p5_report)}
ORACLE["p4_resumed"] = ORACLE["p4_found"]
