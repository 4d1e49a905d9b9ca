"""Change-log and action sources (batch and streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import message_id

# -- fixed values: how the events table stands in for a change log -------------
EVENT_OPS = {"signup": "c", "error": "d"}  # every other event type is "u"


def event_op(col="event_type"):
    c = F.col(col)
    return F.when(c == "signup", F.lit("c")).when(c == "error", F.lit("d")).otherwise(F.lit("u"))


def events_as_changes(events: DataFrame) -> DataFrame:
    """Envelope rows (op, before, after, ts, event_id) keyed by user_id.

    c/u carry the row image in ``after``; d carries it in ``before``.
    """
    img = F.struct(F.col("user_id").alias("id"), "value", "props")
    op = event_op()
    return events.select(
        "event_id",
        "ts",
        op.alias("op"),
        F.when(op == "d", img).alias("before"),
        F.when(op != "d", img).alias("after"),
    )


def events_as_actions(events: DataFrame) -> DataFrame:
    """Session actions: signup = start (mid 0), error = logout (mid null),
    anything else = a message whose id is the epoch millis."""
    t = F.col("event_type")
    millis = message_id("ts", events.schema["ts"].dataType)
    mid = F.when(t == "signup", F.lit(0).cast("long")).when(t == "error", F.lit(None).cast("long")).otherwise(millis)
    return events.withColumn("mid", mid)


def read_many(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union of several sources by column name, tagged with the source name."""
    out = None
    for name, df in frames.items():
        d = df.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def since(df: DataFrame, ts: str, start) -> DataFrame:
    """Start position on a table: 'earliest' = everything, 'latest' = only
    rows newer than the current newest, or a timestamp lower bound."""
    if start == "earliest":
        return df
    if start == "latest":
        return df.where(F.col(ts) > df.select(F.max(ts)).scalar())
    return df.where(F.col(ts) > F.lit(start).cast(df.schema[ts].dataType))


def read_changes(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Streaming change source with an explicit envelope schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def read_inferred(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Streaming source whose columns come from the stored files' metadata."""
    schema = spark.read.format(fmt).load(path).schema
    return read_changes(spark, path, schema, fmt, max_files)
