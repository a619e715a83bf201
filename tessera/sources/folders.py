"""Where a query writes what it reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all executors and the driver share: the session's ``spark.checkpoint.dir``.

    Only a local master gets a temporary one when it is unset.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder below the shared one that nothing else writes."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
