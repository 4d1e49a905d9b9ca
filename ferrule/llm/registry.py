"""Named queries of the package: ``(spark, sf_dir) -> DataFrame``, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def load_all():
    from . import queries  # noqa: F401

    return QUERIES, ORACLE
