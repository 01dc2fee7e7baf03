"""Holding query results against SQL on the same tables."""

import os

import duckdb


def rows_of_sql(sql, sf_dir, **extra):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = os.path.join(sf_dir, name)
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def same(df, sql, sf_dir):
    names, want = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = sorted(repr([r[c] for c in order]) for r in df.collect())
    b = sorted(repr([r[names.index(c)] for c in order]) for r in want)
    assert a == b
