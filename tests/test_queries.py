"""Every query with SQL against DuckDB on the smallest tables; the others must run and have a stable schema."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

SF = str(DATA / "sf0.001")
ORACLE = entry.oracle_sql()
QUERIES = entry.queries()
pytestmark = pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in (DATA / "sf0.001").glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (dt.date, dt.datetime)) else v


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = db.execute(ORACLE[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["day", "l_returnflag", "quantity", "lines", "gross", "per_hundred"]


def test_nothing_outside_imports_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    assert [str(p) for p in root.rglob("rillstone/**/*.py") if "llm" not in p.parts and "rillstone.llm" in p.read_text()] == []
