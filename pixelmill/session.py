"""Settings of the session that operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_folder(spark: SparkSession) -> None:
    """Have a folder for ``checkpoint()``: the session's ``spark.checkpoint.dir``; where it is unset and the master local (tests), a local one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="pixelmill-checkpoints-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder for checkpoints."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
