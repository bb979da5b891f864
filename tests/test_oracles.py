"""Queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from petrel.plans import cases

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(cases.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    got = cases.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = tables.execute(cases.oracle_sql()[name])
    heads = [d[0] for d in want.description]
    assert sorted(heads) == columns
    order = [heads.index(c) for c in columns]
    key = lambda rows: sorted(map(str, rows))
    assert key(rounded(got.select(*[f"`{c}`" for c in columns]).collect())) == key(rounded([tuple(r[k] for k in order) for r in want.fetchall()]))


def rounded(rows):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
