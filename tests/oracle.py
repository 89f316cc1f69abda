"""Runs a query on Spark and its SQL on DuckDB over the same tables, and compares rows."""

from pathlib import Path

import duckdb
import pytest

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def same(spark, query, sql):
    df = query(spark, str(DATA))
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in row) for row in found.fetchall()), key=repr)
    got = sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=repr)
    assert got == want
