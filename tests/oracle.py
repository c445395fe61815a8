"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes)):
        return x
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    try:
        f = float(x)
    except (TypeError, ValueError):
        return str(x)
    return "nan" if math.isnan(f) else round(f, 5) + 0.0


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, db, sql):
    """None if both have the same columns and rows, else what differs."""
    got = [tuple(r) for r in df.collect()]
    result = db.execute(sql)
    columns, want = [d[0] for d in result.description], result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if x != y and not all(u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-5 * max(1, abs(u)) for u, v in zip(x, y, strict=True)):
            return f"{x} and {y}"
    return None
