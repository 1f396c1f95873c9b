"""Compare a query's rows with DuckDB's."""

import datetime
import decimal
import os

import duckdb

SF = "/root/testdata/sf0.001"


def normal(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in found)


def duck(sql, folder=SF):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def check(query, sql, spark, folder=SF):
    df = query(spark, folder)
    names, want = duck(sql, folder)
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, want)
