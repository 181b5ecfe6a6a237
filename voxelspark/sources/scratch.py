"""A place for what a job writes on its way."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share; a local one only on a local master."""
    here = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = str(here.get()) if here.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = f"file://{tempfile.mkdtemp(dir='/tmp/checkpoints')}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
