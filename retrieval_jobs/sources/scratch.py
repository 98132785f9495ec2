"""A place for tables between jobs that all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a session in one process has a folder of its own; on a cluster that is an error, since
    executors would write where nobody else reads.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "retrieval-jobs-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
