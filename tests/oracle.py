"""Runs a registered query and its DuckDB equivalent over the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def same(df, sf_dir, sql):
    names, rows = duck(sf_dir, sql)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    left = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    right = sorted((tuple(norm(r[i]) for i in at) for r in rows), key=repr)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert a == b, (a, b)
    return left
