"""A streaming sink that reports what it delivered: ``writeStream.format("reported")``.

Every task writes its rows to a file of its own below ``<path>/_new`` and
tells the driver in its commit message how many it delivered, their key range
and how many had no key (those cannot be addressed and are counted as failed).
When all tasks of a batch are done the driver moves their files to
``<path>/batch=<id>`` and writes ``<path>/_reports/<id>.json``; a batch that
fails leaves nothing but its removed files, and a batch that runs again
replaces itself.  Files move inside one folder, so a batch is one rename a
task.

Options: ``path`` (a folder that driver and executors share) and ``key``.
Read the rows with ``read_delivered``, the reports with ``delivery_reports``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

FORMAT = "reported"
REPORT = "batch long, rows long, failed long, min_key string, max_key string, partitions array<struct<partition: int, rows: long, failed: long, min_key: string, max_key: string>>"


@dataclass
class Delivered(WriterCommitMessage):
    partition: int
    file: str
    rows: int
    failed: int
    min_key: str | None
    max_key: str | None


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ReportedWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, key: str):
        self.path, self.key = path.rstrip("/"), key

    def write(self, iterator: Iterator) -> Delivered:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        files, root = _fs(self.path)
        files.create_dir(f"{root}/_new", recursive=True)
        name, out = f"{uuid.uuid4().hex}.parquet", None
        rows = failed = 0
        low = high = None
        for batch in iterator:
            key = batch.column(batch.schema.get_field_index(self.key))
            good = batch.filter(key.is_valid())
            failed += batch.num_rows - good.num_rows
            if not good.num_rows:
                continue
            if out is None:
                out = pq.ParquetWriter(f"{root}/_new/{name}", batch.schema, filesystem=files)
            out.write_batch(good)
            rows += good.num_rows
            m = pc.min_max(good.column(batch.schema.get_field_index(self.key))).as_py()
            low, high = m["min"] if low is None else min(low, m["min"]), m["max"] if high is None else max(high, m["max"])
        if out is not None:
            out.close()
        text = lambda x: None if x is None else str(x)
        return Delivered(TaskContext.get().partitionId(), name if out else "", rows, failed, text(low), text(high))

    def commit(self, messages: list, batchId: int) -> None:
        files, root = _fs(self.path)
        own = f"{root}/batch={batchId}"
        if files.get_file_info(own).type.name != "NotFound":
            files.delete_dir(own)  # this batch has run before
        files.create_dir(own, recursive=True)
        files.create_dir(f"{root}/_reports", recursive=True)
        told = [m for m in messages if m is not None]
        for m in told:
            if m.file:
                files.move(f"{root}/_new/{m.file}", f"{own}/{m.file}")
        report = {"batch": batchId, "rows": sum(m.rows for m in told), "failed": sum(m.failed for m in told),
                  "min_key": self._end(told, "min_key", min), "max_key": self._end(told, "max_key", max),
                  "partitions": [{k: v for k, v in vars(m).items() if k != "file"} for m in sorted(told, key=lambda m: m.partition)]}
        with files.open_output_stream(f"{root}/_reports/{batchId}.json") as f:
            f.write(json.dumps(report).encode())

    @staticmethod
    def _end(told: list, name: str, pick):
        ends = [getattr(m, name) for m in told if getattr(m, name) is not None]
        if not ends:
            return None
        return pick(ends, key=lambda x: (0, int(x), "") if x.lstrip("-").isdigit() else (1, 0, x))

    def abort(self, messages: list, batchId: int) -> None:
        files, root = _fs(self.path)
        for m in messages:
            if m is not None and m.file:
                files.delete_file(f"{root}/_new/{m.file}")


class ReportedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema, overwrite: bool) -> ReportedWriter:
        if self.options["key"] not in schema.fieldNames():
            raise ValueError(f"no column {self.options['key']}")
        return ReportedWriter(self.options["path"], self.options["key"])


def write_delivered(stream: DataFrame, path: str, key: str, checkpoint: str) -> None:
    """Run the stream into the sink until all that is there has been delivered."""
    stream.sparkSession.dataSource.register(ReportedSink)
    q = stream.writeStream.format(FORMAT).option("path", path).option("key", key).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()


def read_delivered(spark: SparkSession, path: str, schema) -> DataFrame:
    """The delivered rows with their ``batch``."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")


def delivery_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch: rows, failed rows, key range, and the same of each partition."""
    return spark.read.schema(REPORT).json(f"{path}/_reports/*.json")
