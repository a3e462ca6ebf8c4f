"""The folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpointing(spark: SparkSession) -> None:
    """Sets the checkpoint folder that the cluster names; a local session gets one of its own, others must name theirs."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corvane-"))
