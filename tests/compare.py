"""Runs registered queries in Spark and their SQL in DuckDB and compares values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def differences(df, con, sql: str) -> list[str]:
    """Problems found; empty when both sides agree in columns, types and values."""
    relation = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return [f"columns {names} != {sorted(relation.columns)}"]
    problems = []
    spark_types = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = {n: _kind(str(t).lower()) for n, t in zip(relation.columns, relation.types)}
    for name in names:
        if spark_types[name] != duck_types[name]:
            problems.append(f"type of {name}: {spark_types[name]} != {duck_types[name]}")
    left = sorted((_row(r.asDict(), names) for r in df.collect()), key=repr)
    right = sorted((_row(dict(zip(relation.columns, r)), names) for r in relation.fetchall()), key=repr)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    if unequal:
        problems.append(f"{len(unequal)} rows differ, first: {unequal[0]}")
    return problems


def _row(row: dict, names: list[str]) -> tuple:
    return tuple(_value(row[n]) for n in names)


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _kind(name: str) -> str:
    return {"bigint": "long", "integer": "int", "int": "int", "varchar": "string", "float": "float",
            "double": "double"}.get(name, name)
