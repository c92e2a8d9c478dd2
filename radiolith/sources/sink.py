"""A batch sink for serialized objects: one file an object, and all files of a job or none.

Each attempt of a task writes below a folder of its own name in ``_staging-<job>``; what it sends to the driver is that name and two counts, however many files there
are. The driver's commit moves one folder for each task that Spark has accepted, so that retried and speculative attempts leave no second copy; an
aborted job is its staging folder, which is deleted. An attempt may outlive its job, as Spark ends a job before the last of its tasks: only the driver makes the
staging folder, and renames it before it deletes it, so that such an attempt finds no folder to write to and fails. Objects that cannot be written are rows of a
Parquet table in ``_errors``. Paths may be of any file system that Arrow knows and that renames folders; where opening a file makes its folders too, as on HDFS,
what an attempt writes after the end of its job can stay in the staging folder.
"""

from __future__ import annotations

import posixpath
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "part10files"
FIELDS = ("object_id", "content", "error")
ERRORS = "_errors"
_ERROR = pa.schema([("object_id", pa.string()), ("error", pa.string())])


class SinkError(ValueError):
    """Options or rows that the sink cannot take."""


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + posixpath.abspath(path))


def file_name(object_id: str, suffix: str = ".dcm") -> str:
    """A file's name for an object: its id with all that could be part of a path escaped."""
    name = urllib.parse.quote(object_id, safe=" ,()+=@").replace(".", "%2E")
    return name + suffix


@dataclass
class Committed(WriterCommitMessage):
    attempt: str
    files: int
    errors: int


class Part10Writer(DataSourceArrowWriter):
    """Of rows ``(object_id, content, error)``; a row without content and without error is an error, as is an id that comes twice in a task."""

    def __init__(self, path: str, overwrite: bool, suffix: str = ".dcm") -> None:
        self.path, self.overwrite, self.suffix, self.job = path, overwrite, suffix, uuid.uuid4().hex
        store, root = open_store(path)
        store.create_dir(posixpath.join(root, self.staging), recursive=True)

    @property
    def staging(self) -> str:
        return f"_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        store, root = open_store(self.path)
        attempt = f"part-{uuid.uuid4().hex}"
        own = posixpath.join(root, self.staging, attempt)
        store.create_dir(own, recursive=False)
        seen: set[str] = set()
        errors: list[tuple[str, str]] = []
        for b in iterator:
            for object_id, content, error in zip(*(b.column(c) for c in FIELDS), strict=True):
                name = object_id.as_py()
                if name is None or error.is_valid or not content.is_valid or name in seen:
                    errors.append((name, error.as_py() or ("NO_OBJECT_ID" if name is None else "REPEATED_OBJECT" if name in seen else "NO_CONTENT")))
                    continue
                seen.add(name)
                with store.open_output_stream(posixpath.join(own, file_name(name, self.suffix))) as f:
                    f.write(content.as_buffer())
        if errors:
            table = pa.Table.from_pylist([dict(zip(_ERROR.names, e, strict=True)) for e in errors], schema=_ERROR)
            store.create_dir(posixpath.join(root, self.staging, ERRORS), recursive=False)
            pq.write_table(table, posixpath.join(root, self.staging, ERRORS, f"{attempt}.parquet"), filesystem=store)
        return Committed(attempt, len(seen), len(errors))

    def commit(self, messages: list[Committed | None]) -> None:
        store, root = open_store(self.path)
        done = [m for m in messages if m is not None]
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.base_name.startswith("part-") or old.base_name == ERRORS:
                    store.delete_dir(old.path)
        for m in done:
            if m.files:
                store.move(posixpath.join(root, self.staging, m.attempt), posixpath.join(root, m.attempt))
            if m.errors:
                store.create_dir(posixpath.join(root, ERRORS), recursive=True)
                store.move(posixpath.join(root, self.staging, ERRORS, f"{m.attempt}.parquet"), posixpath.join(root, ERRORS, f"{m.attempt}.parquet"))
        self._clear()

    def abort(self, messages: list[Committed | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = open_store(self.path)
        own = posixpath.join(root, self.staging)
        if store.get_file_info(own).type != fs.FileType.NotFound:
            store.move(own, f"{own}-done")
            store.delete_dir(f"{own}-done")


class Part10Sink(DataSource):
    """``df.write.format("part10files").mode(...).save(path)`` for ``df(object_id, content, error)``; ``spark.dataSource.register(Part10Sink)`` first."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> Part10Writer:
        if "path" not in self.options:
            raise SinkError("the sink needs a path")
        if missing := [c for c in FIELDS if c not in schema.names]:
            raise SinkError(f"rows need the columns {', '.join(missing)}")
        return Part10Writer(self.options["path"], overwrite, self.options.get("suffix", ".dcm"))
