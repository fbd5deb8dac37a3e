"""Comparison of a query with its SQL in DuckDB on the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def canonical(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.10g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in at) for r in rows)


def differences(spark, c, folder, run, sql):
    got = run(spark, folder)
    rows = [tuple(r) for r in got.collect()]
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    a, b = canonical(rows, got.columns), canonical(cursor.fetchall(), names)
    if a != b:
        return f"{len(a)} and {len(b)} rows; first difference {next(((x, y) for x, y in zip(a, b) if x != y), None)}"
    return ""
