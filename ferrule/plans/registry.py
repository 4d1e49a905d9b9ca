"""Named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where
the operator is SQL-expressible, the equivalent DuckDB SQL over the same
tables (views named after the parquet files)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def load_all():
    from . import q_vectors, q_changes, q_text, q_sessions, q_assembly, q_streams  # noqa: F401

    return QUERIES, ORACLE
