"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, kind: str) -> str:
    """A new folder's name below spark.checkpoint.dir, or below a temporary folder where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='translatome-')).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
