"""Sinks: schemaless JSON records, keyed order, log filter, write metrics,
versioned snapshots in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.logs import level_rank


def to_json_records(df: DataFrame, col: str = "value") -> DataFrame:
    """One schemaless JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(col))


def keyed_order(df: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """Keyed sink layout: partitions are ranges of (key, order), sorted, so the
    rows of a key follow each other in order, over several partitions when the
    key is large."""
    d = df.repartitionByRange(parts, key, *order) if parts else df.repartitionByRange(key, *order)
    return d.sortWithinPartitions(key, *order)


def log_filter(df: DataFrame, level: str = "level", min_level: str = "INFO") -> DataFrame:
    """Keep log rows at ``min_level`` or above."""
    return df.where(level_rank(F.col(level)) >= level_rank(F.lit(min_level)))


def with_metrics(df: DataFrame, name: str, key: str):
    """Attach an observation (rows and key range) reported when the data is
    written; returns (df, Observation)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key")), obs


def delivery_report(df: DataFrame, group: str, key: str) -> DataFrame:
    """Per group: rows and key range (the batch view of the write report)."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key")
    )


def write_reported(df: DataFrame, path: str, name: str, key: str) -> dict:
    """Write ``df`` and report what was written: rows and key range seen by the write itself; a failed write is
    reported with its reason instead of raised."""
    observed, obs = with_metrics(df, name, key)
    try:
        observed.write.mode("overwrite").parquet(path)
    except Exception as e:  # noqa: BLE001 - told in the report
        return {"name": name, "status": "failed", "rows": None, "min_key": None, "max_key": None, "message": str(e).splitlines()[0][:500]}
    return {"name": name, "status": "ok", **obs.get, "message": None}
