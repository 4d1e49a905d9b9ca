"""Small relational helpers: membership gates, labels, positional zip,
shared context, ordered steps, categorisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import grouped_scan


def _map(mapping: dict) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


def label(col: Column | str, mapping: dict, default) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_map(mapping)[c], F.lit(default))


def sentinel(col: Column | str, value=-1, shown: str = "N/A") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == value, F.lit(shown)).otherwise(c.cast("string"))


def known_users(df: DataFrame, users: DataFrame, key: str, user_key: str | None = None, known: bool = True) -> DataFrame:
    u = users.select(F.col(user_key or key).alias(key))
    return df.join(u, key, "left_semi" if known else "left_anti")


def zip_pair(a: DataFrame, b: DataFrame, key: str, a_list: str, b_list: str) -> DataFrame:
    """Positional pairing of two lists per key; stops at the shorter."""
    both = a.select(key, a_list).join(b.select(key, b_list), key)  # the lists meet by key, then are cut to the shorter
    n = F.least(F.size(a_list), F.size(b_list))
    pairs = F.arrays_zip(F.slice(a_list, 1, n).alias("a"), F.slice(b_list, 1, n).alias("b"))
    return both.select(key, F.posexplode(pairs).alias("pos", "_p")).select(key, "pos", F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))


def attach_context(sessions: DataFrame, context: DataFrame, name: str = "context") -> DataFrame:
    """One shared value (a one-row, one-column frame) on every row, as a
    scalar subquery (no cross join, nothing through the driver)."""
    return sessions.withColumn(name, context.scalar())


def ordered_steps(df: DataFrame, group: list[str], order: list[str], name: str = "step") -> DataFrame:
    """Deterministic step number per group from an explicit order."""
    return grouped_scan(df, group, order, number=name)


def categorise(source: Column | str, mapping: dict, default: str) -> Column:
    return label(source, mapping, default)
