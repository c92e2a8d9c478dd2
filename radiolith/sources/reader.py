"""Folders of Part 10 files as DataFrames: one task reads many files, and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolith.functions.charset import decode_bytes, label_of
from radiolith.functions.values import CHARSET_LISTS, CHARSET_TEXTS
from radiolith.operators.dictionary import transfer_syntax
from radiolith.operators.elements import decoded
from radiolith.operators.profiles import Profile

from .flat import Plain, Walker, _gathered
from .part10 import Element, Parser, PartError

ELEMENT = "struct<path:string,ord:int,leave:int,tag:string,vr:string,length:bigint,byte_offset:bigint,little_endian:boolean,charset:array<string>,private_creator:string,cp246_promoted:boolean,item_count:int,full_span:boolean,raw:binary,label:string,text:string>"
WARNING = "struct<code:string,tag:string,vr:string,byte_offset:bigint,file_meta:boolean,deflated:boolean>"
ERROR = "struct<code:string,offset:bigint,frame:string,snippet:string,message:string>"
FILE = f"object_id string, had_preamble boolean, meta map<string,string>, residue array<struct<tag:string,vr:string,value:binary>>, elements array<{ELEMENT}>, warnings array<{WARNING}>, error {ERROR}"
#: Bytes of files whose rows go back to the JVM together.
BATCH_BYTES = 4 << 20
_WARNING_FIELDS = ("code", "tag", "vr", "byte_offset", "file_meta", "deflated")


_IN_CHARSET = frozenset((*CHARSET_LISTS, *CHARSET_TEXTS, "PN"))


class _Batch:
    """Rows of files, column by column; an element is a place in the columns of ``ELEMENT``."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self.files = {n: [] for n in ("object_id", "had_preamble", "meta", "residue", "error")}
        self.elements, self.warnings = [[] for _ in schema.field("elements").type.value_type], [[] for _ in _WARNING_FIELDS]
        self.element_ends, self.warning_ends = [0], [0]

    def add(self, data: dict[str, Element], path: str, at: int) -> int:
        """Elements in order, items after their sequence, from ``ord`` ``at`` on; ``leave`` is the last row within a sequence. Returns the next ``ord``."""
        paths, ords, leaves, tags, vrs, lengths, offsets, littles, charsets, creators, promoted, counts, spans, raws, labels, texts = self.elements
        for e in data.values():
            label = label_of(e.charset)
            paths.append(path)
            ords.append(at)
            leaves.append(at)
            tags.append(e.tag)
            vrs.append(e.vr)
            lengths.append(e.length)
            offsets.append(e.offset)
            littles.append(e.little)
            charsets.append(e.charset)
            creators.append(e.creator)
            promoted.append(e.promoted)
            counts.append(None if e.items is None else len(e.items))
            spans.append(e.full_span)
            raws.append(e.raw)
            labels.append(label)
            texts.append(None if label == "latin1" or label == "utf-8" or e.vr not in _IN_CHARSET else decode_bytes(e.raw, label))
            at += 1
            if e.items:
                own = len(leaves) - 1
                for i, item in enumerate(e.items):
                    at = self.add(item, f"{path}/{e.tag}[{i}]" if path else f"{e.tag}[{i}]", at)
                leaves[own] = at - 1
        return at

    def end(self, warnings: list[tuple], **file) -> None:
        for name, column in self.files.items():
            column.append(file.get(name, [] if name in ("meta", "residue") else None))
        for w in warnings:
            for column, x in zip(self.warnings, w, strict=True):
                column.append(x)
        self.element_ends.append(len(self.elements[0]))
        self.warning_ends.append(len(self.warnings[0]))

    def done(self) -> pa.RecordBatch:
        def listed(name: str, ends: list[int], columns: list[list]) -> pa.Array:
            kind = self.schema.field(name).type
            fields = list(kind.value_type)
            inner = pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
            return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), inner, type=kind)

        columns = {n: pa.array(c, type=self.schema.field(n).type) for n, c in self.files.items()}
        columns |= {"elements": listed("elements", self.element_ends, self.elements), "warnings": listed("warnings", self.warning_ends, self.warnings)}
        return pa.RecordBatch.from_arrays([columns[n] for n in self.schema.names], schema=self.schema)


def _slices(content: pa.Array) -> Iterator[tuple[int, int]]:
    """Places in a batch that cut it into parts of about ``BATCH_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(content), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def _plain_rows(got: Plain, paths: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    """The rows of plain files: what :class:`_Batch` makes of them one by one."""
    n, m = len(got.ord), len(got.file)
    listed = lambda name: schema.field(name).type
    empty = lambda kind, size: pa.ListArray.from_arrays(pa.array(np.zeros(size + 1, np.int32)), pa.nulls(0, kind.value_type), type=kind)
    same = lambda x, kind: pa.array([x], kind).take(pa.array(np.zeros(n, np.int32)))
    ends, raw = _gathered(got.arena, got.at, got.length)
    raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    columns = {
        "path": same("", pa.string()), "ord": pa.array(got.ord), "leave": pa.array(got.ord), "tag": got.tag, "vr": got.vr, "length": pa.array(got.length), "byte_offset": pa.array(got.offset), "little_endian": pa.array(got.little),
        "cp246_promoted": same(False, pa.bool_()), "full_span": same(False, pa.bool_()), "raw": raw, "label": same("latin1", pa.string()),
    }
    fields = list(listed("elements").value_type)
    cells = [empty(f.type, n) if f.name == "charset" else columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields]
    inner = pa.StructArray.from_arrays(cells, fields=fields)
    meta, where = [list(x.items()) for x, _ in got.metas], pa.array(got.meta)
    residue = [[dict(zip(("tag", "vr", "value"), r, strict=True)) for r in x] for _, x in got.metas]
    rows = {
        "object_id": paths.take(pa.array(got.file)).cast(listed("object_id")), "had_preamble": pa.array(np.ones(m, bool)), "meta": pa.array(meta, listed("meta")).take(where), "residue": pa.array(residue, listed("residue")).take(where),
        "elements": pa.ListArray.from_arrays(pa.array(got.ends.astype(np.int32)), inner, type=listed("elements")), "warnings": empty(listed("warnings"), m), "error": pa.nulls(m, listed("error")),
    }
    return pa.RecordBatch.from_arrays([rows[name] for name in schema.names], schema=schema)


def parse_content(files: DataFrame, mode: str = "PERMISSIVE", profile: Profile | None = None, strict: bool = False, preamble: str = "auto", vrs: dict[str, str] | None = None) -> DataFrame:
    """One row a file of ``files(path, content)``. PERMISSIVE keeps a broken file as a row with ``error``; FAILFAST raises."""
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError("mode is PERMISSIVE or FAILFAST")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(FILE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, held, count, size = Parser(profile, strict, preamble, vrs), _Batch(schema), 0, 0
        walker = Walker(parser)
        for b in (b.slice(a, z - a) for b in batches for a, z in _slices(b.column(1))):
            plain = walker.read(b.column(1))
            if plain is not None:
                yield _plain_rows(plain, b.column(0), schema)
                left = np.ones(len(b), bool)
                left[plain.file] = False
                b = b.filter(pa.array(left))
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, file = content.as_py() or b"", {}
                try:
                    got = parser.parse(data)
                    file = {"had_preamble": got.had_preamble, "meta": list(got.meta.items()), "residue": [dict(zip(("tag", "vr", "value"), r, strict=True)) for r in got.residue]}
                    held.add(got.data, "", 0)
                except PartError as e:
                    if mode == "FAILFAST":
                        raise
                    file["error"] = {"code": e.code, "offset": e.offset, "frame": e.frame, "snippet": e.snippet, "message": e.what}
                held.end(parser.out.warnings, object_id=path, **file)
                count, size = count + 1, size + len(data)
                if size >= BATCH_BYTES or count == 1024:
                    yield held.done()
                    held, count, size = _Batch(schema), 0, 0
        if count:
            yield held.done()

    return files.select("path", "content").mapInArrow(run, FILE)


def read_files(spark: SparkSession, path: str, glob: str = "*", **options) -> DataFrame:
    """Parsed files below a path; see :func:`parse_content`."""
    return parse_content(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path), **options)


def elements(files: DataFrame) -> DataFrame:
    """The flat element table, with ``encoding`` of the object and ``value``, the decoded text."""
    kind = F.coalesce(transfer_syntax(F.element_at("meta", "transfer_syntax_uid")), F.lit("explicit-le"))
    kind = F.when(kind == "deflated-le", F.lit("explicit-le")).otherwise(kind)
    rows = files.select("object_id", kind.alias("encoding"), F.explode("elements").alias("e")).select("object_id", "encoding", "e.*")
    return decoded(rows, read=(F.col("label"), F.col("text"))).drop("label", "text") if "text" in rows.columns else decoded(rows)


def warnings(files: DataFrame) -> DataFrame:
    return files.select("object_id", F.posexplode("warnings").alias("ord", "w")).select("object_id", "ord", "w.*")


def errors(files: DataFrame) -> DataFrame:
    return files.where("error is not null").select("object_id", "error.*")
