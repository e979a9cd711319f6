"""Run a query and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return v + 0.0 if v == v else "nan"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same_type(spark_type: str, duck_type: str) -> bool:
    pairs = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp": "TIMESTAMP", "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]",
    }
    return pairs.get(spark_type) == duck_type


def compare(spark, con, fn, sql: str | None, sf: str) -> tuple[str, float]:
    """('' when equal, else what differs; seconds of the Spark side)."""
    started = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return ("" if got else "no rows"), seconds
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", seconds
    order = sorted(names)
    left = sorted((tuple(plain(r[df.columns.index(c)]) for c in order) for r in got), key=repr)
    right = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    off = [
        f"{f.name}: {f.dataType.simpleString()}/{types[f.name]}"
        for f in df.schema
        if not same_type(f.dataType.simpleString(), types[f.name])
    ]
    if len(left) != len(right):
        return f"{len(left)} rows, {len(right)} expected", seconds
    diff = [(a, b) for a, b in zip(left, right) if a != b]
    if diff:
        return f"{len(diff)} rows differ, e.g. {order} {diff[0]}", seconds
    return (f"types {off}" if off else ""), seconds
