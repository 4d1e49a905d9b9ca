"""The change log source: start positions, resumption and partitions."""

import datetime as dt
import tempfile

import pytest

from ferrule.sources.change_source import ChangeReader, read_change_log
from ferrule.streaming.runner import run_to_table
from tests.conftest import rows

ROW = "seq long, ts timestamp_ntz, op string, after struct<id: long, v: string>"
T0 = dt.datetime(2024, 1, 1)


def put(spark, path, numbers):
    data = [(n, T0 + dt.timedelta(minutes=n), "u", (n % 3, f"v{n}")) for n in numbers]
    spark.createDataFrame(data, ROW).coalesce(1).write.mode("append").parquet(path)


def test_earliest_resumes_exactly_once_with_files_that_come_between(spark):
    path, base = tempfile.mkdtemp() + "/log", tempfile.mkdtemp()
    seen = []
    for numbers in (range(1, 8), [], [9, 11, 12], range(13, 40)):
        if numbers:
            put(spark, path, numbers)
        out = run_to_table(read_change_log(spark, path, rows_per_partition=5), base=base)
        seen += numbers
        assert rows(spark.read.parquet(out), ["seq"]) == [(n,) for n in seen]
    assert spark.read.parquet(out).where("after.v = 'v11' and after.id = 2").count() == 1


@pytest.mark.parametrize("start, first", [("latest", 8), ("2024-01-01T00:05:00", 5), ("2024-01-01T00:04:30", 5), ("2025-01-01", 8)])
def test_start_positions(spark, start, first):
    path, base = tempfile.mkdtemp() + "/log", tempfile.mkdtemp()
    put(spark, path, range(1, 8))
    go = lambda: run_to_table(read_change_log(spark, path, start=start), base=base)
    go()
    put(spark, path, range(8, 11))
    assert rows(spark.read.parquet(go()), ["seq"]) == [(n,) for n in range(first, 11)]


def test_partitions_are_ranges_without_gaps(spark):
    path = tempfile.mkdtemp() + "/log"
    put(spark, path, range(100, 1000, 7))
    schema = spark.read.parquet(path).schema
    r = ChangeReader(schema, {"path": path, "rows_per_partition": "50"})
    parts = r.partitions(r.initialOffset(), r.latestOffset())
    got = [n for p in parts for b in r.read(p) for n in b.column(0).to_pylist()]
    assert got == list(range(100, 1000, 7)) and all(a.last == b.after for a, b in zip(parts, parts[1:]))
    assert r.partitions(r.latestOffset(), r.latestOffset()) == []
