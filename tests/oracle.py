"""Running a registered query and its SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(folder) / name}.parquet'")
    return connection


def _plain(value):
    """Floats as text, so that a negative zero differs from zero; NaN as null."""
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is not None, v) for v in r))


_SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
}


def differences(frame, connection, sql: str) -> list[str]:
    """What differs between the two results; an empty list when nothing does."""
    relation = connection.sql(sql)
    problems = []
    spark_types = {n: _SPARK_TO_DUCK.get(k, k) for n, k in frame.dtypes}
    duck_types = {n: str(k) for n, k in zip(relation.columns, relation.types)}
    if spark_types != duck_types:
        problems.append(f"schema {spark_types} against {duck_types}")
    if sorted(spark_types) != sorted(duck_types):
        return problems
    ours, theirs = _rows(frame.columns, frame.collect()), _rows(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows against {len(theirs)}")
    elif ours != theirs:
        first = next((a, b) for a, b in zip(ours, theirs) if a != b)
        count = sum(a != b for a, b in zip(ours, theirs))
        problems.append(f"{count} rows differ, first {first}")
    return problems
