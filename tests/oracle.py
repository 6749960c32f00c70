"""Comparison of a query with its DuckDB SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    return round(v, 5) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def same(df, con, sql):
    """Asserts equal columns, types and rows."""
    rel = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for name, kind in df.dtypes:
        assert TYPES.get(kind, kind) == theirs[name], (name, kind, theirs[name])
    order = [rel.columns.index(c) for c in columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    mine = sorted((tuple(map(cell, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    want = sorted((tuple(cell(r[i]) for i in order) for r in rel.fetchall()), key=key)
    assert len(mine) == len(want)
    for a, b in zip(mine, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)), (a, b)
