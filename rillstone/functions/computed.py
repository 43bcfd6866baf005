"""Expressions over finished measures, and small scalar helpers.

An expression is a function of ``{measure: column}`` that knows what it depends
on, so a query reads only the measures it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Computed:
    needs: frozenset[str]
    column: Callable[[Mapping[str, Column]], Column]

    def __add__(self, other):
        return add(self, other)

    def __sub__(self, other):
        return sub(self, other)

    def __mul__(self, other):
        return mul(self, other)

    def __truediv__(self, other):
        return div(self, other)


def _as(x) -> Computed:
    return x if isinstance(x, Computed) else measure(x) if isinstance(x, str) else value(x)


def value(x) -> Computed:
    """A constant."""
    return Computed(frozenset(), lambda _: F.lit(x))


def measure(name: str) -> Computed:
    """A stored measure as it is shown."""
    return Computed(frozenset([name]), lambda m: m[name])


def custom(needs: list[str], column: Callable[[Mapping[str, Column]], Column]) -> Computed:
    return Computed(frozenset(needs), column)


def _binary(a, b, f: Callable[[Column, Column], Column]) -> Computed:
    a, b = _as(a), _as(b)
    return Computed(a.needs | b.needs, lambda m: f(a.column(m), b.column(m)))


def add(a, b) -> Computed:
    return _binary(a, b, lambda x, y: x + y)


def sub(a, b) -> Computed:
    return _binary(a, b, lambda x, y: x - y)


def mul(a, b) -> Computed:
    return _binary(a, b, lambda x, y: x * y)


def div(a, b) -> Computed:
    """A double; 0 where ``b`` is 0."""
    return _binary(a, b, lambda x, y: F.when(y != 0, x.cast("double") / y.cast("double")).otherwise(F.lit(0.0)))


def sqrt(a) -> Computed:
    """0 where ``a`` isn't positive."""
    a = _as(a)
    return Computed(a.needs, lambda m: F.when(a.column(m) <= 0, F.lit(0.0)).otherwise(F.sqrt(a.column(m))))


def sqr(a) -> Computed:
    a = _as(a)
    return Computed(a.needs, lambda m: a.column(m).cast("double") * a.column(m).cast("double"))


def variance(total, squares, n) -> Computed:
    """Of the population, from the sum, the sum of squares and the count."""
    return sub(div(squares, n), sqr(div(total, n)))


def stddev(total, squares, n) -> Computed:
    return sqrt(variance(total, squares, n))


def percent(a, b=None) -> Computed:
    """``a`` times 100, or ``a`` per hundred of ``b``."""
    return mul(a if b is None else div(a, b), value(100.0))


def switch(position: Column, cases: list[Column], default: Column) -> Column:
    """The case at ``position`` (from 0), else ``default``."""
    out = default
    for i in reversed(range(len(cases))):
        out = F.when(position == i, cases[i]).otherwise(out)
    return out


def lookup_value(key: Column, table: Mapping, default=None) -> Column:
    """The value of ``key`` in a small table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))
