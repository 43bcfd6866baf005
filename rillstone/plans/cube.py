"""A cube: dimensions, measures, rollups, and queries routed to the rollups that can answer them.

Planning is on the driver and touches names only; every result is a lazy
DataFrame, so filters and columns reach the Parquet scans of the rollups chosen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from contextlib import AbstractContextManager, ExitStack
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions import predicates as P
from rillstone.functions.computed import Computed
from rillstone.functions.measures import Measure
from rillstone.operators.datasets import first_by


class QueryError(ValueError):
    """The query names something the cube doesn't have, or no rollup can answer it."""


@dataclass(frozen=True)
class Rollup:
    """A group-by kept as a table: its keys, its measures and the rows it covers."""

    name: str
    dims: tuple[str, ...]
    measures: tuple[str, ...]
    predicate: P.Predicate = field(default_factory=P.always_true)
    #: Keys of which a stored chunk never holds two values.
    partition_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Attribute:
    """A column of a lookup table, found by dimensions: ``keys`` maps dimension to key column."""

    table: DataFrame | Callable[[], DataFrame]
    keys: Mapping[str, str]
    column: str

    def rows(self) -> DataFrame:
        """The table as it is now: a callable is asked at each query. Of rows with one key the one with the least columns counts."""
        t = self.table() if callable(self.table) else self.table
        keys = list(self.keys.values())
        return first_by(t, keys, [c for c in t.columns if c not in keys])


@dataclass(frozen=True)
class CubeQuery:
    attributes: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    where: P.Predicate = field(default_factory=P.always_true)
    having: P.Predicate = field(default_factory=P.always_true)
    order: tuple[tuple[str, bool], ...] = ()  # (field, ascending)
    limit: int | None = None
    offset: int = 0
    report: str = "data_with_totals"

    @staticmethod
    def from_params(params: Mapping[str, str], cube: Cube) -> CubeQuery:
        """From the parameters attributes, measures, where, having, sort, limit, offset, reportType."""
        names = lambda k: tuple(x.strip() for x in params.get(k, "").split(",") if x.strip())
        order = []
        for part in names("sort"):
            name, _, way = part.partition(":")
            if way.lower() not in ("", "asc", "desc"):
                raise QueryError(f"unknown order: {way}")
            order.append((name, way.lower() != "desc"))
        pred = lambda k: P.parse(params[k], cube.convert) if params.get(k) else P.always_true()
        return CubeQuery(names("attributes"), names("measures"), pred("where"), pred("having"), tuple(order), int(params["limit"]) if params.get("limit") else None, int(params.get("offset") or 0), params.get("reportType", "data_with_totals").lower())


@dataclass
class QueryResult:
    """Lazy frames: ``records`` in order, ``totals`` (one row), ``total_count`` (one row ``n``), ``filter_attributes`` (one row)."""

    attributes: tuple[str, ...]
    measures: tuple[str, ...]
    sorted_by: tuple[str, ...]
    records: DataFrame | None = None
    totals: DataFrame | None = None
    total_count: DataFrame | None = None
    filter_attributes: DataFrame | None = None
    report: str = "data_with_totals"

    def to_dict(self) -> dict:
        """Everything the report has, for an HTTP answer; a report is a page of rows."""
        out: dict[str, Any] = {"metadata": {"attributes": list(self.attributes), "measures": list(self.measures)}}
        if self.records is None:
            return out
        plain = lambda v: v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v
        rows = lambda df: [{k: plain(v) for k, v in r.asDict().items()} for r in df.collect()]
        out |= {"sortedBy": list(self.sorted_by), "records": rows(self.records), "count": self.total_count.collect()[0]["n"], "filterAttributes": rows(self.filter_attributes)[0] if self.filter_attributes is not None else {}}
        if self.totals is not None:
            out["totals"] = rows(self.totals)[0]
        return out


class Cube:
    """See the module. ``relations`` maps a dimension to its parent, ``attributes`` names like ``dim.name`` to Attributes."""

    def __init__(self, dims: Mapping[str, str], measures: Mapping[str, Measure], rollups: Iterable[Rollup] = (), computed: Mapping[str, Computed] | None = None, relations: Mapping[str, str] | None = None, attributes: Mapping[str, Attribute] | None = None):
        self.dims, self.measures = dict(dims), dict(measures)
        self.computed, self.relations, self.attributes = dict(computed or {}), dict(relations or {}), dict(attributes or {})
        self.rollups = {r.name: r for r in rollups}
        self.data: dict[str, Callable[[P.Predicate, tuple[str, ...]], DataFrame]] = {}
        #: Each gives a context in which stored rollups are seen in one state; a query opens them all.
        self.pins: list[Callable[[], AbstractContextManager]] = []
        self.cost: dict[str, Callable[[P.Predicate, tuple[str, ...]], int]] = {}
        for r in self.rollups.values():
            unknown = (set(r.dims) | r.predicate.dimensions()) - set(self.dims) | set(r.measures) - set(self.measures)
            if unknown:
                raise QueryError(f"rollup {r.name}: unknown {sorted(unknown)}")

    # ---- data

    def consume(self, df: DataFrame, dims: Mapping[str, Column], measures: Mapping[str, Column | None], covers: P.Predicate | None = None) -> dict[str, DataFrame]:
        """Partial results of ``df`` for each rollup that can take them; ``covers`` is what is known of all its rows.

        A rollup takes the rows if it has only these dimensions and at least one
        of these measures; its own predicate stays as a filter unless ``covers``
        implies it, and a rollup that can't match any row is left out.
        """
        covers = covers or P.always_true()
        out = {}
        for r in self.rollups.values():
            own = [m for m in r.measures if m in measures]
            both = P.and_(covers, r.predicate).simplify()
            if not set(r.dims) <= set(dims) or not own or both == P.always_false() or not r.predicate.dimensions() <= set(dims):
                continue
            rows = df if P.within(covers, r.predicate) else df.where(r.predicate.column(dims))
            one = F.lit(1)
            out[r.name] = rows.groupBy(*(dims[d].cast(self.dims[d]).alias(d) for d in r.dims)).agg(*(self.measures[m].partial(one if measures[m] is None else measures[m]).alias(m) for m in own))
        if not out:
            raise QueryError("no rollup takes these rows")
        return out

    def attach(self, name: str, data: DataFrame | Callable[[P.Predicate, tuple[str, ...]], DataFrame], cost: Callable[[P.Predicate, tuple[str, ...]], int] | None = None) -> None:
        """Gives a rollup its rows: a frame of partial results (several may share a key), or a scan asked with the filter and the measures."""
        self.data[name] = data if not isinstance(data, DataFrame) else lambda _where, _measures, df=data: df
        self.cost[name] = cost or (lambda _where, _measures: 0)

    # ---- names

    def convert(self, key: str, v: Any) -> Any:
        """A JSON value as a value of the dimension's type."""
        return dt.date.fromisoformat(v) if self.dims.get(key) == "date" and isinstance(v, str) else v

    def drill_down(self, dim: str) -> list[str]:
        """The parents of a dimension, top first, and itself."""
        out = [dim]
        while (p := self.relations.get(out[0])) is not None:
            out.insert(0, p)
        return out

    def _dims_of(self, attributes: Iterable[str]) -> list[str]:
        out: list[str] = []
        for a in attributes:
            if a in self.dims:
                own = [a]
            elif a in self.attributes:
                own = list(self.attributes[a].keys)
            else:
                raise QueryError(f"Attribute not found: {a}")
            for d in own:
                out += [x for x in self.drill_down(d) if x not in out]
        return out

    # ---- routing

    def candidates(self, dims: Iterable[str], measures: Iterable[str], where: P.Predicate) -> list[Rollup]:
        """Rollups that can answer, best first: most of the measures, least to read, fewest keys."""
        where = where.simplify()
        need = set(dims) | where.dimensions()
        able = [r for r in self.rollups.values() if r.name in self.data and need <= set(r.dims) and set(measures) & set(r.measures) and P.within(where, r.predicate)]
        cost = lambda r: self.cost[r.name](where, tuple(m for m in r.measures if m in set(measures)))
        return sorted(able, key=lambda r: (-len(set(measures) & set(r.measures)), cost(r), len(r.dims), r.name))

    def compatible_measures(self, dims: Iterable[str], where: P.Predicate) -> set[str]:
        """Stored measures that some rollup has for these dimensions and filter."""
        dims = list(dims)
        return {m for m in self.measures if self.candidates(dims, [m], where)}

    def raw(self, dims: list[str], measures: list[str], where: P.Predicate) -> DataFrame:
        """Partial results grouped by ``dims``: each rollup serves the measures not yet served; several are merged by key."""
        where = where.simplify()
        left, parts = list(measures), []
        while left:
            ranked = self.candidates(dims, left, where)
            if not ranked:
                raise QueryError(f"no rollup has {left} by {dims}")
            best = ranked[0]
            own = [m for m in left if m in best.measures]
            rows = self.data[best.name](where, tuple(own))
            here = {d: F.col(f"`{d}`") for d in best.dims}
            if where != P.always_true():
                rows = rows.where(where.column(here))
            parts.append(rows.select(*(here[d] for d in dims), *(F.col(m) for m in own)))
            left = [m for m in left if m not in own]
        if not parts:
            raise QueryError("no measures")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p, allowMissingColumns=True)
        return every.groupBy(*dims).agg(*(self.measures[m].merge(F.col(m)).alias(m) for m in measures))

    # ---- queries

    def _shown(self, stored: Iterable[str], computed: Iterable[str]) -> list[Column]:
        final = {m: self.measures[m].final(F.col(m)) for m in stored}
        return [c.alias(m) for m, c in final.items()] + [self.computed[c].column(final).alias(c) for c in computed]

    def query(self, q: CubeQuery) -> QueryResult:
        with ExitStack() as pins:
            for pin in self.pins:
                pins.enter_context(pin())
            return self._query(q)

    def _query(self, q: CubeQuery) -> QueryResult:
        where, having = q.where.simplify(), q.having.simplify()
        dims = self._dims_of([*q.attributes, *(a for a in having.dimensions() if a in self.attributes)])
        possible = self.compatible_measures(dims, where)
        asked = [*q.measures, *(m for m in having.dimensions() if m in self.measures or m in self.computed), *(m for m, _ in q.order if m in self.measures or m in self.computed)]
        stored, computed = [], []
        for m in asked:
            if m in self.computed and self.computed[m].needs <= possible:
                computed += [m] if m not in computed else []
                stored += [x for x in sorted(self.computed[m].needs) if x not in stored]
            elif m in possible and m not in stored:
                stored.append(m)
        shown = tuple(m for m in q.measures if m in computed or m in stored)
        fields = {*dims, *self.attributes, *stored, *computed}
        order = [(f, up) for f, up in q.order if f in fields and (f not in self.attributes or f in q.attributes)]
        result = QueryResult(q.attributes, shown, tuple(f for f, _ in order), report=q.report)
        if q.report == "metadata":
            return result
        if unknown := having.dimensions() - fields:
            raise QueryError(f"unknown in having: {sorted(unknown)}")
        grouped = self.raw(dims, stored, where)
        rows = grouped.select(*dims, *self._shown(stored, computed))
        looked = [a for a in dict.fromkeys([*q.attributes, *sorted(having.dimensions())]) if a in self.attributes]
        rows = self._look_up(rows, looked)
        here = {f: F.col(f"`{f}`") for f in rows.columns}
        rows = rows.where(having.column(here)) if having != P.always_true() else rows
        result.total_count = rows.agg(F.count(F.lit(1)).alias("n"))
        if q.report == "data_with_totals":
            result.totals = grouped.agg(*(self.measures[m].merge(F.col(m)).alias(m) for m in stored)).select(*self._shown(stored, computed)).select(*shown)
        if order or q.limit is not None or q.offset:
            keys = [here[f].asc_nulls_first() if up else here[f].desc_nulls_last() for f, up in order]
            rows = rows.orderBy(*keys, *(here[d] for d in dims))
            rows = rows.offset(q.offset) if q.offset else rows
            rows = rows.limit(q.limit) if q.limit is not None else rows
        result.records = rows.select(*(here[a] for a in q.attributes), *(here[m] for m in shown))
        pinned = {k: v for k, v in where.fixed().items() if k in self.dims}
        of = [a for a, x in self.attributes.items() if set(x.keys) <= set(pinned)]
        if of:
            one = grouped.sparkSession.range(1).select(*(F.lit(v).cast(self.dims[k]).alias(k) for k, v in pinned.items()))
            result.filter_attributes = self._look_up(one, of).select(*(F.col(f"`{a}`") for a in of))
        return result

    def _look_up(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Left joins of the attributes' tables, one join per table; a missing key gives nulls."""
        tables: dict[tuple, list[str]] = {}
        for a in names:
            x = self.attributes[a]
            tables.setdefault((id(x.table), tuple(sorted(x.keys.items()))), []).append(a)
        for (_, keys), own in tables.items():
            t = self.attributes[own[0]].rows().select(*(F.col(c).alias(f"__key_{d}") for d, c in keys), *(F.col(self.attributes[a].column).alias(a) for a in own))
            on = [rows[d].eqNullSafe(t[f"__key_{d}"]) for d, _ in keys]
            condition = on[0]
            for c in on[1:]:
                condition = condition & c
            rows = rows.join(t, condition, "left").drop(*(f"__key_{d}" for d, _ in keys))
        return rows
