"""Compare a registered query with its SQL on one data folder."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPE_NAMES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
              "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, decimal.Decimal):
        return str(value)
    return str(value)


def difference(df, con, sql):
    """None when both agree in names, types and rows; else what differs."""
    relation = con.sql(sql)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    mine = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()) for f in df.schema}
    if mine != theirs:
        return f"schema {sorted(set(mine.items()) ^ set(theirs.items()))}"
    names = sorted(mine)
    left = sorted(tuple(canonical(row[n]) for n in names) for row in df.collect())
    at = [relation.columns.index(n) for n in names]
    right = sorted(tuple(canonical(row[i]) for i in at) for row in relation.fetchall())
    if left == right:
        return None
    odd = [pair for pair in zip(left, right) if pair[0] != pair[1]][:2]
    return f"rows {len(left)} / {len(right)}, first differences {odd}"
