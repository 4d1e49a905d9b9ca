"""Spark session and shared-storage helpers.

The library never creates its own cluster configuration: on a cluster the
session comes from the platform, and the only thing we read from it is
``spark.checkpoint.dir`` (the shared folder used to cut lineage and to hold
streaming checkpoints and snapshot tables).  Only when that setting is unset
(local tests) do we point it at a fresh scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", app: str = "ferrule") -> SparkSession:
    """Session for tests and the local bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FERRULE_DRIVER_MEM", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session.  Only a local session without that setting gets a
    fresh scratch folder of its own; on a cluster the setting is required,
    since a folder of one machine is not seen by the others.  Everything the
    library writes (lineage cuts, stream checkpoints, snapshots) goes below it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_ferrule_dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        d = tempfile.mkdtemp(prefix="ferrule-chk-")
        spark.sparkContext._ferrule_dir = d
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ferrule/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below this application's part of the shared folder."""
    return f"{_run_folder(spark)}/{name}/{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it names (no error if it is not there)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote below the shared folder (call it when its results are stored)."""
    remove_path(spark, _run_folder(spark))


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once a session, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_ferrule_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="ferrule-zip-"), "ferrule.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "ferrule")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._ferrule_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for a large run (e.g. 100 TB over ~1000 executors).

    Shuffle partitions are sized so one partition holds about
    ``partition_bytes`` of the largest shuffle (taken as the input size) and
    there are at least 3 waves of tasks; AQE then coalesces small ones and
    splits skewed ones at run time.
    """
    slots = executors * cores_per_executor
    parts = max(3 * slots, input_bytes // partition_bytes)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(min(partition_bytes, 512 << 20)),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.session.timeZone": "UTC",
    }
