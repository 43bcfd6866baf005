"""Queries p6 to p8. None has SQL: the tests hold them against brute force, round trips and planted pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import mixing, spam, tokens
from rillstone.scratch import cut


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each document."""
    return tokens.encode(_table(spark, d, "documents"), "text", ("doc_id",))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture, document by document."""
    targets = _table(spark, d, "mix_targets")
    return mixing.mix(mixing.sizes(_table(spark, d, "documents"), targets), targets)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares by source."""
    targets = _table(spark, d, "mix_targets")
    sized = cut(mixing.sizes(_table(spark, d, "documents"), targets), "sizes").df
    return mixing.shares(mixing.mix(sized, targets), sized, targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Spam pages."""
    return spam.flag(_table(spark, d, "documents")).select("doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of words in lists of each page, to the nearest hundredth."""
    docs = _table(spark, d, "documents")
    return spam.list_shares(docs, spam.fit(docs)).select("doc_id", F.round("list_share", 2).alias("list_share"))


QUERIES = {f.__name__: f for f in (p6_ids, p7_mix, p7_shares, p8_found, p8_shares)}
ORACLE: dict[str, str] = {}
