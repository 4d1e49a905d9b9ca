"""Typed seed tables and idempotent inserts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def seed_table(spark: SparkSession, schema, rows) -> DataFrame:
    return spark.createDataFrame(rows, schema)


class DuplicateKeys(ValueError):
    """A batch offers keys that are there already, or one key twice."""


def _joined(a: DataFrame, b: DataFrame, key: list[str], how: str) -> DataFrame:
    b = b.select(*[F.col(k).alias(f"_k_{k}") for k in key])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]  # a null key is a key like any other
    return a.join(b, reduce(and_, on), how)


def insert_new(table: DataFrame, batch: DataFrame, key: list[str], on_duplicate: str = "skip") -> DataFrame:
    """Insert a batch by key: ``skip`` leaves out keys that are there already,
    ``fail`` raises :class:`DuplicateKeys` for them (and for a key that the
    batch has twice), as a plain insert into a keyed table does."""
    if on_duplicate == "fail":
        twice = batch.groupBy(*key).count().where("count > 1").select(*key)
        some = _joined(batch, table, key, "left_semi").select(*key).unionByName(twice).limit(5).collect()
        if some:
            raise DuplicateKeys(f"keys already there: {[tuple(r) for r in some]}")
        return table.unionByName(batch)
    return table.unionByName(_joined(batch, table, key, "left_anti"))
