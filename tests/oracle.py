"""Compare a query's rows with those of its DuckDB SQL."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "tolist"):
        return tuple(cell(v) for v in x.tolist())
    if isinstance(x, (list, tuple)):
        return tuple(cell(v) for v in x)
    return x


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if columns and rows (in any order) are the same."""
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    a = Counter(tuple(cell(r[n]) for n in names) for r in df.collect())
    at = {n: i for i, n in enumerate(rel.columns)}
    b = Counter(tuple(cell(r[at[n]]) for n in names) for r in rel.fetchall())
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only Spark: {list((a - b).items())[:2]}; only DuckDB: {list((b - a).items())[:2]}"
