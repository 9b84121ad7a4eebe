"""Comparison of a query with its SQL oracle in DuckDB."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(columns, rows, names):
    at = [names.index(c) for c in columns]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


def same(df, sql):
    found = connection().sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    assert rows_of(columns, [tuple(r) for r in df.collect()], df.columns) == rows_of(columns, found.fetchall(), found.columns)
