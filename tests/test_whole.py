"""Registered queries that answer for every row of their tables, against their SQL."""

import glob
import os

import duckdb
import pytest

from weftline.plans import registry
from weftline.plans.tables import d

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, key, table", [("r_unique_names", "user_id", "customer"), ("v_rolled_back", "dataset_id", "datasets")])
def test_whole_query(spark, name, key, table):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = registry.QUERIES[name](spark, SF)
    whole = d(spark, SF, table) if table == "datasets" else spark.read.parquet(f"{SF}/{table}.parquet")
    rows = sorted(str(tuple(r[c] for c in sorted(got.columns))) for r in got.collect())
    assert len(rows) == whole.count() and got.select(key).distinct().count() == len(rows)
    want = con.sql(registry.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in sorted(got.columns)]
    assert rows == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_slug_of_whole_texts(spark):
    name = "t_slug"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = {r["doc_id"]: r["out"] for r in registry.QUERIES[name](spark, SF).collect()}
    want = con.sql(registry.ORACLE_SQL[name])
    assert want.columns == ["doc_id", "out"] and got == dict(want.fetchall())
    assert max(map(len, got.values())) > 1000
