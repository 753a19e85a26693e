"""Every engine query against its SQL on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from stemspark.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 9) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(([plain(r[c]) for c in sorted(got.columns)] for r in got.collect()), key=str)
    if name not in ORACLE:
        assert rows
        return
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    assert rows == sorted(([plain(r[k]) for k in order] for r in want.fetchall()), key=str)
