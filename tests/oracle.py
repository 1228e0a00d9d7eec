"""Comparison of a query with its SQL in DuckDB."""

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def duck(sf_dir=DATA):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def assert_same(spark, f, sql, sf_dir=DATA):
    got, want = f(spark, sf_dir).toPandas(), duck(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert len(got) == len(want)
    got, want = (d[cols].sort_values(cols, ignore_index=True) for d in (got, want))
    for c in cols:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[~same].head(), want[~same].head())
