"""Compares a query's rows with those of SQL in DuckDB over the same tables."""

import decimal
import math
import os


def rows_of(sql, folder):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    result = con.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 5) if math.isfinite(v) else str(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def assert_same(df, sql, folder):
    names, expected = rows_of(sql, folder)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in expected), key=str)
    assert len(got) == len(want)
    assert got == want
