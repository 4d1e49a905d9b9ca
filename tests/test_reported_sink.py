"""The reporting sink: counts and key ranges per batch, and no half batch when a task dies."""

import glob
import tempfile

import pytest

from ferrule.sources import reported_sink as R
from tests.conftest import rows

ROW = "k long, v string"


def put(spark, path, data, parts=1):
    spark.createDataFrame(data, ROW).repartition(parts).write.mode("append").parquet(path)


def test_reports_per_batch(spark):
    src, out, chk = tempfile.mkdtemp() + "/in", tempfile.mkdtemp(), tempfile.mkdtemp()
    put(spark, src, [(i, f"v{i}") for i in range(9, 30)] + [(None, "lost")], 3)
    stream = lambda: spark.readStream.schema(ROW).parquet(src)
    R.write_delivered(stream(), out, "k", chk)
    put(spark, src, [(5, "a"), (100, "b")])
    R.write_delivered(stream(), out, "k", chk)
    got = [r.asDict(recursive=True) for r in R.delivery_reports(spark, out).orderBy("batch").collect()]
    assert [(r["rows"], r["failed"], r["min_key"], r["max_key"]) for r in got] == [(21, 1, "9", "29"), (2, 0, "5", "100")]
    assert sum(p["rows"] for p in got[0]["partitions"]) == 21 and sum(p["failed"] for p in got[0]["partitions"]) == 1
    assert rows(R.read_delivered(spark, out, ROW), ["k"]) == [(i,) for i in [5, *range(9, 30), 100]]
    assert not glob.glob(f"{out}/_new/*")


def test_a_task_that_dies_leaves_no_half_batch(spark, monkeypatch):
    src, out, chk = tempfile.mkdtemp() + "/in", tempfile.mkdtemp(), tempfile.mkdtemp()
    put(spark, src, [(i, "x") for i in range(40)], 4)
    stream = lambda bad: spark.readStream.schema(ROW).parquet(src).selectExpr("k", "v", f"assert_true(k <> {bad}) AS ok").select("k", "v", "ok")
    with pytest.raises(Exception):
        R.write_delivered(stream(17), out, "k", chk)
    assert not glob.glob(f"{out}/batch=*") and not glob.glob(f"{out}/_reports/*")
    R.write_delivered(stream(-1), out, "k", chk)
    assert R.read_delivered(spark, out, ROW).count() == 40
    assert [r.rows for r in R.delivery_reports(spark, out).collect()] == [40]


def test_a_batch_that_is_committed_again_replaces_itself(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    w = R.ReportedWriter(str(tmp_path), "k")
    for _ in range(2):
        (tmp_path / "_new").mkdir(exist_ok=True)
        pq.write_table(pa.table({"k": [1]}), tmp_path / "_new/a.parquet")
        w.commit([R.Delivered(0, "a.parquet", 1, 0, "1", "1"), None], 7)
    assert len(glob.glob(f"{tmp_path}/batch=7/*")) == 1 and len(glob.glob(f"{tmp_path}/_reports/*")) == 1
    pq.write_table(pa.table({"k": [1]}), tmp_path / "_new/b.parquet")
    w.abort([R.Delivered(0, "b.parquet", 1, 0, "1", "1"), None], 8)
    assert not glob.glob(f"{tmp_path}/_new/*")
