"""A place for what a query writes on its way."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the session names in ``spark.checkpoint.dir``; below a temporary one where it names none and runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        root = "file://" + tempfile.mkdtemp(prefix="radiolith-")
    return posixpath.join(root.rstrip("/"), f"{name}-{uuid.uuid4().hex}")
