"""Places in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which a cluster sets; in a local session without it, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = getattr(checkpoint_folder, "local", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = checkpoint_folder.local = tempfile.mkdtemp(prefix="marlstone-")
    spark.sparkContext.setCheckpointDir(known)
    return known


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path there."""
    return f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"


def if_small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A narrow side of a join, marked for broadcast if it was counted to have at most ``most`` rows; else the join shuffles."""
    return F.broadcast(rows) if rows.count() <= most else rows
