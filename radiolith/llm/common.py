"""What the corpus operators share: the cluster's shared folder, written tables and Arrow plumbing.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``: any executor
can be lost after they are written without anything being computed again.
"""

from __future__ import annotations

import ctypes
import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where the session names none and runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="radiolith-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return posixpath.join(shared_root(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def small_range_samples(spark: SparkSession, rows: int = 10) -> Iterator[None]:
    """Within it a range exchange sends the driver about ``3 * rows`` keys a partition, for keys as long as texts."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a folder in the shared store, whatever its scheme."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch of Python lists or numpy arrays under ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def trim() -> None:
    """Give back the memory that a finished task used: a worker stays for the next one, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim_heap = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim_heap:
        trim_heap(0)
