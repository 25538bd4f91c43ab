"""Every query with SQL gives what DuckDB gives for that SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from paperloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def cells(rows):
    plain = lambda v: float(v) if isinstance(v, float) else v
    return sorted(repr(tuple(map(plain, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert cells(tuple(r) for r in got.select(*names).collect()) == cells(want)


def test_inventory():
    """Every query has SQL and names the inventory's rows that it applies; all rows have one but user-interface state, browser automation and what nothing uses."""
    assert set(catalog.COVERS) == set(catalog.QUERIES) == set(catalog.ORACLES)
    have = {row for rows in catalog.COVERS.values() for row in rows}
    last = {"S": 19, "K": 9, "P": 34, "F": 20, "J": 22, "A": 15, "W": 13, "O": 8, "U": 7, "C": 7}
    want = {f"{k}{i}" for k, n in last.items() for i in range(1, n + 1)} | {"2.7a", "2.7b", "2.7c", "2.7d", "2.12"}
    assert want - have == {"S17", "S19", "K8", "U7"} and have <= want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
