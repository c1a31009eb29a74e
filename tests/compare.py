"""Rows of Spark and of DuckDB in one form."""

import decimal


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((repr(tuple(plain(r[c]) for c in names)) for r in df.collect()))


def duck_rows(connection, sql):
    r = connection.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(c) for c in names]
    return names, sorted(repr(tuple(plain(x[k]) for k in at)) for x in r.fetchall())
