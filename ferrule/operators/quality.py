"""Row contracts, quarantine, key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reasons array<string>``: names of the rules a row breaks.

    A rule is a boolean Column that is true for a *good* row; null counts
    as broken.  One pass, no job failure on bad rows.
    """
    checks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("reasons", F.filter(F.array(*checks), lambda r: r.isNotNull()))


def split_bad(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) halves of one contract check."""
    r = with_reasons(df, rules)
    return r.where(F.size("reasons") == 0).drop("reasons"), r.where(F.size("reasons") > 0)


def quarantine(df: DataFrame, id_cols: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per (bad row, broken rule)."""
    r = with_reasons(df, rules)
    return r.select(*id_cols, F.explode("reasons").alias("reason"))


def vector_contract(vec: Column, dim: int) -> dict[str, Column]:
    return {
        "null_vector": vec.isNotNull(),
        "wrong_dimension": F.size(vec) == F.lit(dim),
        "null_element": ~F.exists(vec, lambda x: x.isNull()),
    }


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (primary-key check)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
