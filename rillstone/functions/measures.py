"""Measures that can be aggregated in steps: from rows, from partial results, to the value shown.

Each measure is three column expressions, so Spark's own two-phase aggregation
does the work and a rollup of a rollup is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """``partial`` aggregates input values, ``merge`` partial results, ``final`` shows one; ``zero`` stands where there is nothing."""

    name: str
    partial: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    final: Callable[[Column], Column] = lambda c: c
    zero: Callable[[], Column | None] = lambda: None


def sum_(kind: str = "double") -> Measure:
    """Sum; nothing is 0. Integers are summed as bigint."""
    wide = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else kind
    return Measure("sum", lambda c: F.sum(c.cast(wide)), F.sum, lambda c: F.coalesce(c, F.lit(0).cast(wide)), lambda: F.lit(0).cast(wide))


def min_() -> Measure:
    """Least value; null where there is none."""
    return Measure("min", F.min, F.min)


def max_() -> Measure:
    return Measure("max", F.max, F.max)


def count() -> Measure:
    """Rows, whatever the column."""
    return Measure("count", lambda c: F.count(F.lit(1)), F.sum, lambda c: F.coalesce(c, F.lit(0).cast("bigint")), lambda: F.lit(0).cast("bigint"))


def union(kind: str = "bigint") -> Measure:
    """The set of values, sorted; nothing is the empty set.

    For sets that stay small per group. Large ones belong into a key: count
    distinct rows, or use ``distinct`` for an estimate.
    """
    empty = lambda: F.expr(f"cast(array() as array<{kind}>)")
    return Measure("union", lambda c: F.array_sort(F.collect_set(c.cast(kind))), lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), lambda c: F.coalesce(c, empty()), empty)


def distinct(log2_registers: int = 12) -> Measure:
    """Estimated number of distinct values by a mergeable sketch of bounded size."""
    return Measure("distinct", lambda c: F.hll_sketch_agg(c, F.lit(log2_registers)), lambda c: F.hll_union_agg(c), lambda c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0).cast("bigint")))


def custom(name: str, partial: Callable[[Column], Column], merge: Callable[[Column], Column], final: Callable[[Column], Column] = lambda c: c) -> Measure:
    """A user's own measure."""
    return Measure(name, partial, merge, final)


# Multipliers of the 64-bit finaliser (public MurmurHash3).
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _register(values: pd.Series, registers: pd.Series) -> pd.DataFrame:
    h = values.to_numpy(np.int64).view(np.uint64).copy()
    m = registers.to_numpy(np.int64)
    h ^= h >> np.uint64(33)
    for k in _MIX:
        h *= np.uint64(k)
        h ^= h >> np.uint64(33)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    rest = h >> np.uint64(32)
    lowest = rest & (~rest + np.uint64(1))
    rank = np.where(rest == 0, 64, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64)) + 1
    return pd.DataFrame({"register": (low & (m - 1)).astype(np.int32), "rank": rank.astype(np.int32)})


def registers(df: DataFrame, keys: list[str], value: str, m: int = 1024) -> DataFrame:
    """``keys, register, rank``: the HyperLogLog registers of a bigint column, one row each. Merging is the greatest rank per register.

    Null values are ignored. Rows, not arrays: a hot key is up to m rows from each task.
    """
    register = F.pandas_udf(_register, "struct<register int, rank int>")
    r = df.where(F.col(value).isNotNull()).select(*keys, register(F.col(value).cast("bigint"), F.lit(m).cast("bigint")).alias("r"))
    return r.groupBy(*keys, F.col("r.register").alias("register")).agg(F.max("r.rank").alias("rank"))


def estimate(regs: DataFrame, keys: list[str], m: int = 1024) -> DataFrame:
    """``keys, estimate`` from registers: the harmonic mean, or linear counting while it is small; as an integer."""
    # Bias constants of the published algorithm.
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    empty = F.lit(m) - F.count(F.lit(1))
    inverse = empty.cast("double") + F.sum(F.pow(F.lit(2.0), -F.col("rank")))
    raw = F.lit(alpha * m * m) / inverse
    linear = F.lit(float(m)) * F.log(F.lit(float(m)) / F.nullif(empty.cast("double"), F.lit(0.0)))
    value = F.when((raw < 2.5 * m) & (empty > 0), linear).otherwise(raw)
    return regs.groupBy(*keys).agg(value.cast("int").alias("estimate"))
