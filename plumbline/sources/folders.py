"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Only a local session without one (as in tests) gets a temporary folder instead.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="plumbline-")
    return root.rstrip("/")


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name below the checkpoint folder."""
    return f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
