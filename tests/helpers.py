"""Comparing a query with its SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, dict):
        return str(sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(canon(r[k]) for k in order) for r in rows)


def duck(sf_dir, sql, replaced=()):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{dict(replaced).get(t, f'{sf_dir}/{t}.parquet')}')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), rows_of(columns, found.fetchall())


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns, want = duck(sf_dir, sql)
    assert sorted(df.columns) == columns
    got = rows_of(df.columns, df.collect())
    assert got == want
    return got
