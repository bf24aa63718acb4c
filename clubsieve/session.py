"""Session helpers for tests, the bench and cluster runs."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", partitions: str = "8", app: str = "clubsieve") -> SparkSession:
    """A small session for tests and the bench. On a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own_folder[0]


def enable_checkpoints(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder unless the context already has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def settle(df):
    """The frame as a reliable checkpoint: it is computed once and survives lost executors."""
    enable_checkpoints(df.sparkSession)
    return df.checkpoint()


def settle_as_laid(df):
    """The frame as a reliable checkpoint that keeps the partitioning of its last shuffle.

    A checkpoint keeps its partitioning only where its plan is not adaptive, so that is switched
    off while it is written.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return settle(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def settle_by(df, *keys):
    """The frame as a reliable checkpoint, partitioned by the keys: later joins on them do not move it."""
    return settle_as_laid(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys))
