"""Comparison of a Spark query with DuckDB SQL on the driver's tables."""

import datetime
import decimal
import os

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata")


def duck(sql, sf):
    """Column names and rows as Python values."""
    con = duckdb.connect()
    folder = f"{DATA}/{sf}"
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    got = con.sql(sql)
    return list(got.columns), got.fetchall()


def exact(v):
    """A value with its kind: whole numbers stay whole, whatever their size."""
    if v is None or isinstance(v, (bool, int)):
        return type(v).__name__, v
    if isinstance(v, decimal.Decimal):
        return ("int", int(v)) if v == int(v) else ("decimal", v.normalize())
    if isinstance(v, float):
        return "float", repr(v)
    if isinstance(v, (bytes, bytearray)):
        return "bytes", bytes(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return "time", v.isoformat()
    return type(v).__name__, v


def plain(columns, rows, ordered=False):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    out = [tuple(exact(r[k]) for k in at) for r in rows]
    return [columns[k] for k in at], out if ordered else sorted(out, key=repr)


def assert_same(frame, sql, sf, ordered=False):
    columns, rows = duck(sql, sf)
    assert plain(frame.columns, frame.collect(), ordered) == plain(columns, rows, ordered)
