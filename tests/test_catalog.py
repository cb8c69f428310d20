"""Every registered query of the library gives the rows of its SQL."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from pipeloom.plans import catalog

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in os.listdir(SF):
        c.sql(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{p}')")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.sql(catalog.ORACLES[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert rows == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)
