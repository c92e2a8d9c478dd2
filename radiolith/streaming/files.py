"""Folders that grow: the parser as a streaming query. It is a function of each file, so it keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from radiolith.sources.reader import elements, parse_content

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_elements(spark: SparkSession, path: str, glob: str = "*", **options) -> DataFrame:
    """Elements of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob).load(path)
    return elements(parse_content(files, **options))
