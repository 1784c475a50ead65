"""Runs a query in Spark and its SQL in DuckDB and compares the rows as unordered bags."""

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return value


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(df, con, sql):
    """None when both engines agree, else a short description."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = bag(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    found = bag(df.columns, [tuple(row) for row in df.collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows against {len(expected)}"
    for mine, theirs in zip(found, expected):
        if mine != theirs:
            return f"{mine} against {theirs}"
    return None
