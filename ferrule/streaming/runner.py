"""Run Structured Streaming queries to completion into the shared folder.

Every run writes below ``spark.checkpoint.dir``: ``<base>/chk`` (offsets and
state, so a restart resumes exactly once) and ``<base>/out`` (the sink).
``availableNow`` processes everything present and stops, so the same code
serves a continuously running deployment (use a processing-time trigger)
and a bounded test.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def stream_path(sf_dir: str, name: str) -> str:
    """Streaming source path of a table, as a pattern that matches its folder
    or its single file alike (file sources list a folder; the store is only
    read by Spark)."""
    p = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return p[:-1] + "[" + p[-1] + "]"


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    p = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(p).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(stream_path(sf_dir, name))


def run_to_table(df: DataFrame, base: str | None = None, name: str = "stream", mode: str = "append",
                 foreach_batch=None, trigger: dict | None = None, wait: bool = True):
    """Run ``df`` into parquet at ``<base>/out``; return that path.

    ``trigger`` defaults to ``availableNow`` (process what is there, then
    stop); a live deployment passes e.g. ``{"processingTime": "10 seconds"}``
    with ``wait=False`` and gets ``(path, query)`` back.  With
    ``foreach_batch(batch_df, batch_id, out_path)`` the function writes the
    batch itself (must be idempotent per batch id).
    """
    spark = df.sparkSession
    base = base or scratch_path(spark, name)
    out = f"{base}/out"
    w = df.writeStream.option("checkpointLocation", f"{base}/chk").trigger(**(trigger or {"availableNow": True}))
    w = w.outputMode(mode)
    if foreach_batch is not None:
        q = w.foreachBatch(lambda b, i: foreach_batch(b, i, out)).start()
    else:
        q = w.format("parquet").option("path", out).start()
    if not wait:
        return out, q
    q.awaitTermination()
    return out


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """A folder of Parquet files with a known schema; None if nothing was ever written there.  Any other
    failure to read is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_output(spark: SparkSession, out: str, schema) -> DataFrame:
    """Read a sink folder; a run that wrote nothing gives an empty frame of ``schema``."""
    df = read_if_there(spark, out, schema)
    return spark.createDataFrame([], schema) if df is None else df.select(*[f.name for f in schema.fields])


FILE_ROWS = 1 << 20  # rows of a staged file, about


def staged(spark: SparkSession, df: DataFrame, order: str, parts: int = 3, name: str = "staged", file_rows: int = FILE_ROWS) -> tuple[str, int]:
    """Write a table as ``parts`` sets of files one after another, cut by the values of ``order``: a source folder that
    :func:`read_staged` reads in that many micro-batches.  Returns the folder and how many files each set has: as many as
    the smallest can fill, so that a large table is written and read by many tasks.  (The cut points are two numbers.)"""
    path = scratch_path(spark, name)
    n = F.col(order) if df.schema[order].dataType.typeName() in ("long", "integer") else F.unix_micros(F.col(order).cast("timestamp"))
    lo, hi = df.agg(F.min(n), F.max(n)).first()
    step = (hi - lo) // parts + 1 if lo is not None else 1
    part = F.floor((n - F.lit(lo)) / F.lit(step)) if lo is not None else F.lit(0)
    part = F.coalesce(part, F.lit(0)).cast("int")
    rows = dict(df.groupBy(part.alias("part")).count().collect())  # a number for each part
    files = max(1, min(rows.get(i, 0) for i in range(parts)) // file_rows)
    for i in range(parts):
        some = df.where(part == i)
        # dealt row by row, so no file is empty: a part has far more rows than its scan has tasks times files
        (some.coalesce(1) if files == 1 else some.repartition(files)).write.option("maxRecordsPerFile", 0).mode("append").parquet(path)
    return path, files


def read_staged(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
