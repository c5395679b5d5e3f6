"""Registered queries of the lineage engine against their SQL, on the smallest tables."""

import os
from pathlib import Path

import pytest

from weftline.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).is_dir():
        pytest.skip(f"no tables in {SF}")
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    order = lambda row: tuple((x is not None, x) for x in row)
    mine = sorted((tuple(r) for r in got.select(columns).collect()), key=order)
    theirs = sorted(duck.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall(), key=order)
    assert len(mine) == len(theirs) > 0
    assert mine == theirs
