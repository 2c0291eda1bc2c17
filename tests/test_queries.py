"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def tidy(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n != "pipeline"))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(tidy(r[c]) for c in columns) for r in df.collect()]
    if name not in entry.oracle_sql():
        assert got or name in ("collapse_bubbles",)
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(tidy(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    key = lambda r: [(x is None, str(type(x)), x) for x in r]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
