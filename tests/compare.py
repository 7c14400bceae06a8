"""Rows of a query against rows of SQL."""

from __future__ import annotations

import os

import duckdb


def norm(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(norm, value))
    return value


def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{sf_dir}/{name}')")
    return con


def same_rows(df, sql, sf_dir):
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = tables(sf_dir).sql(sql)
    names = list(found.columns)
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]
