"""Where jobs store tables that they read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_place(spark: SparkSession, name: str) -> str:
    """A path not used before, in the folder of spark.checkpoint.dir, which all executors share.

    Without the setting a session on local threads gets a temporary folder; any other is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
