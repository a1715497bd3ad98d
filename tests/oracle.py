"""Side-by-side comparison of a registered query with its SQL twin."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        return ("decimal", value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    return value


def _kind(value):
    return None if value is None else type(value).__name__


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def differences(spark_df, con, statement: str, limit: int = 4) -> list[str]:
    """Empty when names, types, row count and every value agree."""
    collected = [tuple(r) for r in spark_df.collect()]
    return compare(spark_df.columns, collected, con, statement, limit)


def compare(columns: list[str], rows, con, statement: str, limit: int = 4) -> list[str]:
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    oracle = canonical(names, result.fetchall())
    ours = canonical(columns, rows)
    problems = []
    if sorted(names) != sorted(columns):
        problems.append(f"columns {sorted(columns)} vs {sorted(names)}")
        return problems
    if len(ours) != len(oracle):
        problems.append(f"rows {len(ours)} vs {len(oracle)}")
    if ours != oracle:
        a, b = set(map(repr, ours)), set(map(repr, oracle))
        problems += [f"ours   {r}" for r in sorted(a - b)[:limit]] + [f"oracle {r}" for r in sorted(b - a)[:limit]]
        if not problems:
            problems.append("same distinct rows, different multiplicity")
    return problems
