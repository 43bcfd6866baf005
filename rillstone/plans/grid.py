"""Pages of a table for a grid on screen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, fields: list[str], key: str, filters: Mapping[str, Column] | None = None, sort: Mapping[str, bool] | None = None, offset: int = 0, limit: int | None = None, extra: list | None = None) -> DataFrame:
    """``fields`` of the rows that pass all ``filters`` (field -> condition), sorted (field -> ascending) with ``key`` last, one page of them; rows whose key is in ``extra`` come in addition."""
    rows = df
    for condition in (filters or {}).values():
        rows = rows.where(condition)
    order = [F.col(f).asc_nulls_first() if up else F.col(f).desc_nulls_last() for f, up in (sort or {}).items()]
    rows = rows.orderBy(*order, key).offset(offset)
    rows = rows.limit(limit) if limit is not None else rows
    out = rows.select(*dict.fromkeys([key, *fields]))
    if extra:
        more = df.where(F.col(key).isin(extra)).select(*out.columns)
        out = out.unionByName(more.join(out.select(key), key, "left_anti"))
    return out.select(*fields)
