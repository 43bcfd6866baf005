"""Lookup joins that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_SHARE rows; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 200


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """Keys holding more than 1/``share`` of the non-null rows: fewer than ``share`` values, whatever the size.

    Counts are combined before the shuffle, and only the hot keys come to the driver.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.sum("n")).scalar()
    rows = counts.where(F.col("n") * share > every).select(key).collect()
    return sorted(r[key] for r in rows)


def lookup(left: DataFrame, right: DataFrame, key: str, spread: list[str], hot: list | None = None) -> DataFrame:
    """Left join of ``left`` to ``right``, a lookup table with one row per ``key``.

    Rows of hot keys don't meet in a shuffle: they get their columns from a
    broadcast of those lookup rows (fewer than HOT_SHARE, as ``right`` has one
    row a key) and are spread by a hash of the columns ``spread`` instead. The
    rest join by key. Null keys find nothing, stay, and are spread too.
    """
    if hot is None:
        hot = hot_keys(left, key)
    more = [c for c in right.columns if c != key]
    is_cold = F.col(key).isNotNull()
    if hot:
        few = right.where(F.col(key).isin(hot)).select(F.col(key).alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in more))
        left = left.join(F.broadcast(few), left[key] == few["__hot"], "left")
        is_cold = is_cold & ~F.col(key).isin(hot)
    side = F.when(is_cold, F.lit(1)).otherwise(-1 - F.pmod(F.xxhash64(*spread), F.lit(1000))).cast("int")
    a = left.withColumn("__side", side)
    one = (F.pmod(F.xxhash64(key), F.lit(1)) + 1).cast("int")  # not a constant: that would be folded, and the spreading with it
    b = right.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__cold_{c}") for c in more), one.alias("__side2"))
    out = a.join(b, (a["__side"] == b["__side2"]) & (a[key] == b["__key"]), "left")
    kept = [c for c in left.columns if not c.startswith("__hot")]
    return out.select(*kept, *((F.coalesce(F.col(f"__hot_{c}"), F.col(f"__cold_{c}")) if hot else F.col(f"__cold_{c}")).alias(c) for c in more))


def salted(left: DataFrame, right: DataFrame, key: str, spread: list[str], hot: list, salts: int = 64) -> DataFrame:
    """As ``lookup``, without a broadcast: for lookup rows of any size. Those of the ``hot`` keys are there ``salts`` times, each for its part of the left rows."""
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.col(key).isin(hot)
    a = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(0).cast("int"))
    b = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "__salt"], "left").drop("__salt")
