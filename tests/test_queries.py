"""Every registered query of the engine's own against its SQL, on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.001"


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9))
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    key = sorted(got.columns)
    rows = sorted([shown(r[k]) for k in key] for r in got.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == key
    at = [want.columns.index(k) for k in key]
    assert rows == sorted([shown(r[i]) for i in at] for r in want.fetchall())
