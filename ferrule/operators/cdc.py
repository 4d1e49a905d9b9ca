"""Change logs: envelope unwrap, fold to current state, state order,
compaction, retention, audit lines.

A change row is ``(op, before, after, seq...)`` with ``op`` in c/u/d (r/t
possible).  ``seq`` is one or more columns giving the log order; every fold
compares them as one struct, so ties never depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seq(seq: list[str]) -> Column:
    return F.struct(*[F.col(s) for s in seq])


def unwrap_changes(df: DataFrame, key: str = "id", mode: str = "sql", keep: list[str] | None = None) -> DataFrame:
    """(op, key, payload fields...) from an envelope.

    ``mode="sql"``: a delete takes ``before``, every other op ``after``
    (so a snapshot ``r`` is an upsert).  ``mode="consumer"``: c/u take
    ``after``, anything else ``before`` -- an ``r`` row then has no payload
    and is flagged ``bad`` for quarantine.
    """
    op = F.col("op")
    if mode == "sql":
        payload = F.when(op == "d", F.col("before")).otherwise(F.col("after"))
    elif mode == "consumer":
        payload = F.when(op.isin("c", "u"), F.col("after")).otherwise(F.col("before"))
    else:
        raise ValueError(mode)
    keep = keep or []
    out = df.select(*keep, "op", payload.alias("_p"))
    fields = [f.name for f in df.schema["after"].dataType.fields if f.name != key]
    return out.select(
        *keep,
        "op",
        F.col(f"_p.{key}").alias(key),
        *[F.col(f"_p.{f}").alias(f) for f in fields],
        F.col("_p").isNull().alias("bad"),
    )


def current_state(changes: DataFrame, key: str, seq: list[str], deletes: str = "hard",
                  payload: list[str] | None = None) -> DataFrame:
    """Fold to one row per key: last write wins; ``d`` removes (hard) or
    blanks the payload (soft: strings -> '', others -> null, ``deleted``).

    ``max_by`` aggregates partially before the shuffle, so a hot key costs
    one row per map task, not one task.
    """
    payload = payload or [c for c in changes.columns if c not in {key, "op", *seq}]
    last = changes.groupBy(key).agg(
        F.max_by(F.struct("op", *payload, *seq), _seq(seq)).alias("_l")
    ).select(key, "_l.*")
    if deletes == "hard":
        return last.where(F.col("op") != "d")
    if deletes == "soft":
        types = dict(changes.dtypes)
        blank = {
            c: F.when(F.col("op") == "d", F.lit("") if types[c] == "string" else F.lit(None).cast(types[c])).otherwise(F.col(c))
            for c in payload
        }
        return last.withColumns(blank).withColumn("deleted", F.col("op") == "d")
    raise ValueError(deletes)


def state_order(changes: DataFrame, key: str, seq: list[str], payload: list[str] | None = None) -> DataFrame:
    """Live state plus its place: ``first_*`` = first write since the key's
    last delete (an update keeps its place; delete + insert moves to the end).
    """
    payload = payload or [c for c in changes.columns if c not in {key, "op", *seq}]
    last_d = changes.where(F.col("op") == "d").groupBy(key).agg(F.max(_seq(seq)).alias("_last_d"))
    after = changes.join(last_d, key, "left").where(
        F.col("_last_d").isNull() | (_seq(seq) > F.col("_last_d"))
    )
    agg = after.groupBy(key).agg(
        F.min(_seq(seq)).alias("_first"),
        F.max_by(F.struct("op", *payload, *seq), _seq(seq)).alias("_l"),
    )
    return agg.select(
        key, "_l.*", *[F.col(f"_first.{s}").alias(f"first_{s}") for s in seq]
    )


def compact(df: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """Log compaction: the latest row per key, tombstones included."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), _seq(seq)).alias("_l")).select(key, "_l.*")


def retain(df: DataFrame, ts: str, age: str) -> DataFrame:
    """Delete policy: keep rows younger than ``age`` relative to the newest
    row (a scalar subquery, no cross join)."""
    newest = df.select(F.max(ts)).scalar()
    return df.where(F.col(ts) >= newest - F.expr(f"INTERVAL {age}"))


def orphan_deletes(changes: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """Keys whose first delete comes before any insert/update."""
    s = _seq(seq)
    g = changes.groupBy(key).agg(
        F.min(F.when(F.col("op").isin("c", "u", "r"), s)).alias("_w"),
        F.min(F.when(F.col("op") == "d", s)).alias("_d"),
        F.count(F.when(F.col("op") == "d", 1)).alias("n_deletes"),
    )
    return g.where(F.col("_d").isNotNull() & (F.col("_w").isNull() | (F.col("_d") < F.col("_w")))).select(
        key, *[F.col(f"_d.{c}").alias(f"first_delete_{c}") for c in seq]
    )


def change_audit(changes: DataFrame, source: str, key: str, payload: list[str] | str) -> DataFrame:
    """Audit line per change: ``Deleted <source> for <key>``; for a keyed item
    table (a list of payload columns) ``Upserted <source> for <key>: <json>``,
    for a text table (one column name) ``Loaded <source> for <key>: <text>``."""
    k = F.col(key).cast("string")
    if isinstance(payload, str):
        told = F.concat(F.lit(f"Loaded {source} for "), k, F.lit(": "), F.coalesce(F.col(payload).cast("string"), F.lit("None")))
    else:
        told = F.concat(F.lit(f"Upserted {source} for "), k, F.lit(": "), F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}))
    line = F.when(F.col("op") == "d", F.concat(F.lit(f"Deleted {source} for "), k)).otherwise(told)
    return changes.withColumn("audit", line)
