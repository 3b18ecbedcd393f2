"""Every posting query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest
from millrace.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in [
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
        "benchmark", "labels", "conversations",
    ]:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, int) and not isinstance(v, bool):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert got and df.columns
        return
    cur = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    rows = lambda xs: sorted((tuple(plain(v) for v in x) for x in xs), key=repr)
    want = rows([tuple(r[names.index(c)] for c in order) for r in cur.fetchall()])
    assert rows([tuple(r[c] for c in order) for r in got]) == want
