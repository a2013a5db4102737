"""Compares a query with its SQL in DuckDB, row by row."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def rows(cols, data):
    def norm(v):
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(norm, v)) + "]"
        return repr(v) if isinstance(v, float) else str(v)

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def check(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = connect(sf_dir).execute(sql)
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows(cols, res.fetchall())
