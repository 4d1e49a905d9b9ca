"""A change log as a streaming source of its own: ``spark.readStream.format("changes")``.

The log is a folder of Parquet files that only grows; every row has a number
in ``seq`` that rises with time.  An offset is the last number read, so a
restart goes on exactly there, whatever files came since; a batch is cut into
partitions by ranges of numbers, which the executors read with the filter
pushed down to the files.

Options: ``path``; ``seq`` (default ``seq``); ``start``: ``earliest``
(default), ``latest`` (only rows that come later), or a timestamp, compared
with the column ``ts`` (default ``ts``; the first row not before it is the
first read); ``rows_per_partition``.  Rows without a number are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "changes"


class Range(InputPartition):
    """Rows with numbers above ``after`` up to ``last``."""

    def __init__(self, after: int, last: int):
        self.after, self.last = after, last


class ChangeReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.path, self.seq, self.ts = options["path"], options.get("seq", "seq"), options.get("ts", "ts")
        self.start, self.rows = options.get("start", "earliest"), int(options.get("rows_per_partition", 100_000))
        if self.rows < 1:
            raise ValueError("rows_per_partition must be 1 or more")

    def _files(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path, format="parquet")

    def _ends(self, where=None) -> tuple[int | None, int | None]:
        """Least and greatest number, scanned batch by batch."""
        import pyarrow.compute as pc

        low = high = None
        for b in self._files().scanner(columns=[self.seq], filter=where).to_batches():
            m = pc.min_max(b.column(0)).as_py()
            if m["min"] is not None:
                low, high = m["min"] if low is None else min(low, m["min"]), m["max"] if high is None else max(high, m["max"])
        return low, high

    def initialOffset(self) -> dict:
        low, high = self._ends()
        if low is None:
            return {"seq": -1 << 62}
        if self.start == "earliest":
            return {"seq": low - 1}
        if self.start == "latest":
            return {"seq": high}
        import datetime as dt

        import pyarrow.compute as pc

        first, _ = self._ends(pc.field(self.ts) >= dt.datetime.fromisoformat(self.start))
        return {"seq": high if first is None else first - 1}

    def latestOffset(self) -> dict:
        high = self._ends()[1]
        return {"seq": -1 << 62 if high is None else high}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        import pyarrow.compute as pc

        a, b = start["seq"], end["seq"]
        low = self._ends(pc.field(self.seq) > a)[0] if b > a else None
        if low is None:
            return []
        return [Range(x, min(x + self.rows, b)) for x in range(max(a, low - 1), b, self.rows)]

    def read(self, partition: Range) -> Iterator:
        import pyarrow.compute as pc

        own = (pc.field(self.seq) > partition.after) & (pc.field(self.seq) <= partition.last)
        for b in self._files().scanner(columns=self.names, filter=own).to_batches():
            if b.num_rows:
                yield b

    def commit(self, end: dict) -> None:
        """Nothing to release: the log keeps its rows."""


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(ds.dataset(self.options["path"], format="parquet").schema)

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(schema, self.options)


def read_change_log(spark: SparkSession, path: str, seq: str = "seq", start: str = "earliest", schema: StructType | None = None, **options) -> DataFrame:
    """The stream of a change log; without a schema its columns come from the stored files."""
    spark.dataSource.register(ChangeSource)
    r = spark.readStream.format(FORMAT).option("path", path).option("seq", seq).option("start", start).options(**options)
    return (r.schema(schema) if schema is not None else r).load()
