"""Every query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return (None if math.isnan(v) else repr(v)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    found = db.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    want = sorted([tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()], key=str)
    assert got == want and (got or name.startswith("check"))
