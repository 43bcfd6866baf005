"""Replicated state that merges by aggregation: counters, sets, stores.

States are rows, one per slot or element, not blobs: a merge is a union and an
aggregate with partial results, which commutes and may be repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.operators.datasets import rendezvous


def g_counter(slots: DataFrame, key: str = "key", replica: str = "replica", value: str = "value") -> DataFrame:
    """``key, value``: per replica the greatest count seen, summed."""
    return slots.groupBy(key, replica).agg(F.max(value).alias(value)).groupBy(key).agg(F.sum(value).alias(value))


def pn_counter(slots: DataFrame, key: str = "key", replica: str = "replica", up: str = "p", down: str = "n") -> DataFrame:
    """``key, value``: increments less decrements, each a grow-only counter."""
    best = slots.groupBy(key, replica).agg(F.max(F.coalesce(up, F.lit(0))).alias("p"), F.max(F.coalesce(down, F.lit(0))).alias("n"))
    return best.groupBy(key).agg((F.sum("p") - F.sum("n")).alias("value"))


def g_set(elements: DataFrame, key: str = "key", element: str = "element") -> DataFrame:
    """Distinct ``key, element``."""
    return elements.select(key, element).distinct()


def tp_set(adds: DataFrame, removes: DataFrame, key: str = "key", element: str = "element") -> DataFrame:
    """Two-phase set: what was added and never removed."""
    return g_set(adds, key, element).join(removes.select(key, element), [key, element], "left_anti")


def lww_set(operations: DataFrame, key: str = "key", element: str = "element", at: str = "at", removed: str = "removed") -> DataFrame:
    """Last writer wins, adding before removing at equal times."""
    gone = F.coalesce(F.col(removed), F.lit(False))
    last = operations.groupBy(key, element).agg(F.max(F.when(~gone, F.col(at))).alias("a"), F.max(F.when(gone, F.col(at))).alias("r"))
    return last.where(F.col("a").isNotNull() & (F.col("r").isNull() | (F.col("a") >= F.col("r")))).select(key, element)


class Store:
    """Keyed states with times and tombstones, as frames ``key, state columns..., ts`` and ``key, ts``.

    ``merge`` maps each state column to its aggregate. A key lives if it was
    written after it was last removed; then all its states count, older ones too.
    """

    def __init__(self, merge: dict[str, Callable[[Column], Column]], states: DataFrame, tombstones: DataFrame | None = None, key: str = "key"):
        self.merge, self.key = dict(merge), key
        self.states, self.tombstones = states, tombstones

    def upload(self, states: DataFrame) -> Store:
        return Store(self.merge, self.states.unionByName(states), self.tombstones, self.key)

    def remove(self, keys: DataFrame) -> Store:
        """``keys``: ``key, ts`` of removals."""
        every = keys if self.tombstones is None else self.tombstones.unionByName(keys)
        return Store(self.merge, self.states, every, self.key)

    def read(self) -> DataFrame:
        """The merged states of the keys that live."""
        live = self.states.groupBy(self.key).agg(*(f(F.col(c)).alias(c) for c, f in self.merge.items()), F.max("ts").alias("ts"))
        if self.tombstones is None:
            return live
        gone = self.tombstones.groupBy(self.key).agg(F.max("ts").alias("__gone"))
        return live.join(gone, self.key, "left").where(F.col("__gone").isNull() | (F.col("__gone") < F.col("ts"))).drop("__gone")

    def download(self, token=None) -> DataFrame:
        """States changed at or after ``token``; all without one."""
        rows = self.read()
        return rows if token is None else rows.where(F.col("ts") >= token)

    def consolidated(self) -> Store:
        """One state per living key, no tombstones."""
        return Store(self.merge, self.read().select(self.states.columns), None, self.key)

    def placed(self, partitions: list[str], copies: int) -> DataFrame:
        """The states with ``shard``: the partitions that hold a copy of each key. Read after a change of ``partitions``, it is the repartitioning."""
        return rendezvous(self.states, F.col(self.key), partitions, copies)

    @staticmethod
    def cluster(stores: list[Store]) -> Store:
        """All replicas read as one."""
        out = stores[0]
        for s in stores[1:]:
            out = out.upload(s.states.select(out.states.columns))
            out = out.remove(s.tombstones) if s.tombstones is not None else out
        return out
