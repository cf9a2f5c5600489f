"""Every registered query against the SQL that it equals, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from palimpsest import catalog

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return str(v) if isinstance(v, bool | int | str) else f"{float(v):.9g}"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(map(canon, r)) for r in df.select(*columns).collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(map(canon, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
