"""Rows of a query and of its SQL, in one form."""

import math


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def rows_of(df):
    names = sorted(df.columns)
    return sorted((repr(tuple(plain(r[c]) for c in names)) for r in df.collect()))


def rows_of_sql(duck, sql):
    found = duck.sql(sql)
    names = found.columns
    return sorted(repr(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names))) for r in found.fetchall())
