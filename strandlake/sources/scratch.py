"""A folder for files that a query derives from its tables and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_uri(spark: SparkSession, label: str) -> str:
    """A fresh place in the folder that driver and executors share (spark.checkpoint.dir); where that is unset,
    one of this machine, if driver and executors are one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="strandlake-")
    base = base if ":" in base else f"file://{base}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
