"""Run a query in Spark and its SQL in DuckDB and compare types, rows and values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty when both sides agree."""
    relation = con.sql(sql)
    spark_cols, duck_cols = sorted(df.columns), sorted(relation.columns)
    if spark_cols != duck_cols:
        return [f"columns {spark_cols} != {duck_cols}"]
    problems = []
    spark_types = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), "?") for f in df.schema}
    duck_types = dict(zip(relation.columns, map(str, relation.types)))
    for name in spark_cols:
        if spark_types[name] != duck_types[name]:
            problems.append(f"type of {name}: {spark_types[name]} != {duck_types[name]}")
    at = [relation.columns.index(c) for c in duck_cols]
    right = sorted(
        (tuple(_plain(row[i]) for i in at) for row in relation.fetchall()), key=repr
    )
    left = sorted(
        (tuple(_plain(row[c]) for c in spark_cols) for row in df.collect()), key=repr
    )
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3] if len(left) < 50_000 else []
        only_right = [r for r in right if r not in set(left)][:3] if len(left) < 50_000 else []
        problems.append(f"values differ: spark {str(only_left)[:900]} duckdb {str(only_right)[:900]}")
    return problems
