"""Every query runs and, where there is comparison SQL, gives the same rows as DuckDB at the smallest scale."""

import math
import os

import pytest

import __spark_entry__ as engine

from .conftest import SF

SLOW = {"pipeline"}


def norm(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.6g}" if abs(v) < 1e15 else str(int(v))
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - SLOW))
def test_query(spark, duck, name):
    df = engine.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in engine.oracle_sql():
        found = duck.execute(engine.oracle_sql()[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert norm(rows) == norm([tuple(r[i] for i in order) for r in found.fetchall()])


def test_entry(spark):
    assert engine.entry(spark).count() > 0
