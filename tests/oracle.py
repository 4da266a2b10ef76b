"""Compare a registered query with its SQL in DuckDB, as bags of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        f = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    return x


def bag(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def differences(spark_df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    got = bag(spark_df.columns, spark_df.collect())
    rel = con.sql(sql)
    want = bag(rel.columns, rel.fetchall())
    if sorted(spark_df.columns) != sorted(rel.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(rel.columns)}"
    if got == want:
        return ""
    a, b = [x for x in got if x not in set(want)], [x for x in want if x not in set(got)]
    return f"{len(got)} rows != {len(want)}; only Spark: {a[:3]}; only SQL: {b[:3]}"
