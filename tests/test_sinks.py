"""Sinks: write report through an observation, keyed layout, log filter."""

from pyspark.sql import functions as F

from ferrule.functions.logs import level_rank
from ferrule.sources.sinks import keyed_order, log_filter, with_metrics


def test_write_metrics_observation(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (5, "b"), (3, "c")], "k long, v string")
    observed, obs = with_metrics(df, "write", "k")
    observed.write.parquet(str(tmp_path / "out"))
    assert obs.get == {"rows": 3, "min_key": 1, "max_key": 5}


def test_keyed_order_and_log_filter(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (2, 0), (1, 1)], "key long, seq long")
    parts = keyed_order(df, "key", ["seq"], parts=4).rdd.glom().collect()
    for p in parts:
        for key in {r["key"] for r in p}:
            seqs = [r["seq"] for r in p if r["key"] == key]
            assert seqs == sorted(seqs)
        # every key lives in exactly one partition
    keys = [r["key"] for p in parts for r in p]
    assert sorted(set(keys)) == [1, 2]
    logs = spark.createDataFrame([("DEBUG",), ("INFO",), ("ERROR",), ("",)], "level string")
    assert sorted(r[0] for r in log_filter(logs).collect()) == ["ERROR", "INFO"]
    assert spark.range(1).select(level_rank(F.lit("WARNING"))).first()[0] == 30


def test_cluster_conf_sizes_partitions():
    from ferrule.session import cluster_conf

    c = cluster_conf(100 << 40, executors=1000, cores_per_executor=8)
    assert int(c["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)  # 256 MB a partition
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = cluster_conf(1 << 30, executors=10, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 120  # at least 3 waves of 40 slots
