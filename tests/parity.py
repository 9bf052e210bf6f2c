"""Rows of a query and of its SQL, in a form that compares."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def of_sql(con, sql):
    done = con.execute(sql)
    names = [c[0] for c in done.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(plain(r[i]) for i in at) for r in done.fetchall())
