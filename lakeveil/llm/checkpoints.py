"""Reliable cuts of lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as the session names it. Only where that is unset and the master is this machine
    alone, as in tests, a new temporary folder is used; on a cluster it must be set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def durable(frame: DataFrame) -> DataFrame:
    """``frame`` with its lineage cut by a checkpoint in the shared folder. What was shuffled for it is of no more use then and leaves the disks at once;
    else it would stay until the driver happens to collect its garbage."""
    spark = frame.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return frame.select("*").checkpoint()  # a frame of its own, as a frame keeps the setting that it was made under
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
