"""Session helpers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A session for tests and the local benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Tables partitioned by symbol join on (symbol, date) as they are, without another shuffle.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        # Window stages are CPU-bound: keep all local cores busy even on small shuffles.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster where it isn't installed: its functions run in their workers."""
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # read by the driver only, which serves it to the executors
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tidemark", "zip", root.parent, root.name))


def _setting(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    return value or spark.sparkContext.getConf().get(key, None)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables.

    The cluster's shared folder (``spark.checkpoint.dir``) is used whenever the
    session names one, so every executor can read what another wrote. Only a
    local session without that setting (tests) gets a folder of its own; any
    other master must name the shared folder.
    """
    root = _setting(spark, "spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
