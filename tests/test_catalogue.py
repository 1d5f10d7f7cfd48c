"""Every catalogue query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from corpusloom.plans import lifecycle  # noqa: F401
from corpusloom.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(repr(round(r[i], 5) + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows])


def close(a, b):
    try:
        return math.isclose(float(a), float(b), abs_tol=2e-5)
    except ValueError:
        return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    rel = duck.sql(SQL[name])
    want = plain(rel.fetchall(), rel.columns)
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    assert all(all(close(x, y) for x, y in zip(a, b)) for a, b in zip(got, want))
