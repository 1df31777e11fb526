"""Every query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from codeweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    want = db.sql(ORACLES[name])
    at = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(want.columns) == sorted(df.columns)
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("province", ["ON", "BC", "YT"])
def test_layout_in_ranges(spark, db, province):
    """The parser's rows where every page is a range of its own."""
    from codeweave.plans.queries import _layout_query

    df = _layout_query(province, 1)(lambda t: spark.read.parquet(f"{SF}/{t}.parquet"))
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    want = db.sql(ORACLES[f"layout_{province.lower()}"])
    at = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
