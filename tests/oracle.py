"""Comparison of a query's rows with those of its SQL in DuckDB."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return v + 0.0
    if isinstance(v, datetime.datetime | datetime.date):
        return str(v)
    return v


def compare(df, sql, path):
    """None if names and rows agree, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    key = lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, bool | int | float) else (v is None, "n", v) for v in r)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:3]}" if bad else None
