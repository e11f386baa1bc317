"""Spark results against DuckDB's, as multisets of rows."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(source):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{source}')")
    return con


def normal(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql):
    got = df.collect()
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    a, b = rows_of(df.columns, got), rows_of(relation.columns, relation.fetchall())
    assert len(a) == len(b), f"{len(a)} rows, SQL has {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, wrong[:3]
