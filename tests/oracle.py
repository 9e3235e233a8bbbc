"""Side-by-side comparison of a registered query with its SQL twin."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

FAMILIES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def difference(spark_df, con, sql: str) -> str | None:
    """None when schema and rows agree, else a short account."""
    names = sorted(spark_df.columns)
    spark_types = dict(spark_df.dtypes)
    cursor = con.execute(sql)
    sql_types = {c[0]: str(c[1]) for c in cursor.description}
    if names != sorted(sql_types):
        return f"columns {names} != {sorted(sql_types)}"
    order = [c[0] for c in cursor.description]
    theirs = [tuple(plain(r[order.index(n)]) for n in names) for r in cursor.fetchall()]
    mine = [tuple(plain(r[n]) for n in names) for r in spark_df.collect()]
    types = [
        (n, spark_types[n], sql_types[n])
        for n in names
        if FAMILIES.get(spark_types[n]) and FAMILIES[spark_types[n]] != sql_types[n]
    ]
    if types:
        return f"types differ: {types}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    mine.sort(key=repr)
    theirs.sort(key=repr)
    for a, b in zip(mine, theirs):
        if a != b:
            return f"first difference: {a!r:.400} != {b!r:.400}"
    return None
