"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; where it is unset, in local mode only, below /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:///tmp/checkpoints/arborel"
    return f"{found.rstrip('/')}/arborel-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
