"""Runs a query and its DuckDB counterpart on the same tables and compares rows."""

import datetime
import decimal
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, decimal.Decimal)):
        return float(x)
    if isinstance(x, float):
        return float(f"{x:.12g}")
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def database(sf):
    d = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return d


def differences(df, db, sql):
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    b = rows_of(names, want.fetchall())
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; first {a[1][:1]} and {b[1][:1]}"
    for x, y in zip(a[1], b[1]):
        if x != y:
            return f"{x} and {y}"
    return ""
