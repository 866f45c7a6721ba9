"""Rows of a Spark query against those of its SQL in DuckDB."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def rows(columns, found):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(df, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(sql)
    want = rows([d[0] for d in got.description], got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert have[0] == want[0]
    assert len(have[1]) == len(want[1])
    assert have[1] == want[1]
