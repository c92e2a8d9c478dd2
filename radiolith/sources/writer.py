"""Element rows back to Part 10 bytes, in the transfer syntax they came from, in the JVM.

Only the deflated syntax passes through Python, for its compression.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from radiolith.functions import values as V
from radiolith.operators import nesting
from radiolith.operators.dictionary import TRANSFER_SYNTAXES, transfer_syntax

from .part10 import META

IMPLEMENTATION_UID = "2.25.318470112936640985512264719012467392145"
PREAMBLE = "00" * 128 + "4449434D"
#: The file meta group length's header: (0002,0000) UL, four bytes.
LENGTH_HEADER = "02000000554C0400"
#: Representations of the file meta elements that are not UI.
META_VRS = {"00020001": "OB", "00020013": "SH", "00020016": "AE"}


def _with_file_meta(files: DataFrame) -> DataFrame:
    """Adds ``head``: the file meta group in tag order, with its length; version and implementation are filled in. Null if a value is too long."""
    defaults = {"00020001": F.unhex(F.lit("0001")), "00020012": F.encode(F.lit(IMPLEMENTATION_UID), "ISO-8859-1")}
    parts = []
    for tag, name in META.items():
        if name == "group_length":
            continue
        text = F.element_at("meta", name)
        raw = F.unhex(text) if tag == "00020001" else F.encode(text, "ISO-8859-1")
        raw = F.coalesce(raw, defaults[tag]) if tag in defaults else raw
        parts.append(F.struct(F.lit(tag).alias("tag"), F.lit(META_VRS.get(tag, "UI")).alias("vr"), raw.alias("value")))
    kind = "array<struct<tag:string,vr:string,value:binary>>"
    every = F.concat(F.filter(F.array(*parts), lambda x: x["value"].isNotNull()).cast(kind), F.coalesce("residue", F.array().cast(kind)).cast(kind))
    rows = files.withColumn("_parts", F.transform(F.array_sort(every), lambda x: F.struct(x["tag"].alias("tag"), x["vr"].alias("vr"), V.pad_even(x["value"], x["vr"]).alias("raw"))))
    one = lambda x: F.concat(nesting.header(x["tag"], x["vr"], F.length(x["raw"]), F.lit("explicit-le")), x["raw"])
    rows = rows.withColumn("_body", F.aggregate(F.transform("_parts", one), F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x)))
    rows = rows.withColumn("_length", F.length("_body"))
    length = F.concat(F.unhex(F.lit(LENGTH_HEADER)), F.unhex(nesting.number(F.col("_length"), 4, F.lit(False))))
    return rows.withColumn("head", F.concat(length, F.col("_body"))).drop("_parts", "_body", "_length")


@F.arrow_udf(BinaryType())
def _deflated(body: pa.Array) -> pa.Array:
    def one(data: bytes) -> bytes:
        out = zlib.compress(data, wbits=-15)
        return out + b"\0" * (len(out) % 2)

    return pa.array([None if x is None else one(x) for x in body.to_pylist()], pa.binary())


def serialize(files: DataFrame, elements: DataFrame, rebuild: bool = True) -> DataFrame:
    """``(object_id, content, error)`` of ``files(object_id, meta, residue)`` and their element rows.

    Sequences are written from the rows of their items, with defined lengths, so that they show what was changed; without ``rebuild`` they are
    copied as they came. Group lengths are left out. ``error`` says why a file cannot be written: MISSING_TRANSFER_SYNTAX,
    UNSUPPORTED_TRANSFER_SYNTAX, or VALUE_TOO_LONG for a value that its header's two bytes of length cannot hold. A file without elements is its file meta.
    The element rows are read twice, once for lengths and once for values: write or checkpoint them before, if they are dear.
    """
    kind = transfer_syntax(F.element_at("meta", "transfer_syntax_uid"))
    own = files.select("object_id", "meta", "residue", kind.alias("encoding"))
    syntax = own.select(F.col("object_id").alias("_f"), F.col("encoding").alias("_encoding"))
    rows = elements.drop("encoding").join(syntax, F.col("object_id") == F.col("_f")).drop("_f").withColumnRenamed("_encoding", "encoding").where("encoding is not null")
    bodies = nesting.data_sets(rows, rebuild).withColumnRenamed("object_id", "_o")
    met = _with_file_meta(own).join(bodies, F.col("object_id") == F.col("_o"), "left")
    error = (
        F.when(F.element_at("meta", "transfer_syntax_uid").isNull(), "MISSING_TRANSFER_SYNTAX").when(F.col("encoding").isNull(), "UNSUPPORTED_TRANSFER_SYNTAX")
        .when(F.col("broken") | F.col("head").isNull(), "VALUE_TOO_LONG")
    )
    met = met.withColumn("error", error).withColumn("body", F.coalesce("body", F.unhex(F.lit(""))))
    packed = F.col("error").isNull() & (F.col("encoding") == "deflated-le")
    body = F.when(packed, _deflated(F.when(packed, F.col("body")))).otherwise(F.col("body"))
    content = F.concat(F.unhex(F.lit(PREAMBLE)), F.col("head"), body)
    return met.select("object_id", F.when(F.col("error").isNull(), content).alias("content"), "error")


def _head_of(uid: str) -> bytes:
    """Preamble and file meta group of a file whose meta names nothing but its transfer syntax; see :func:`_with_file_meta`."""
    own = (("00020001", "OB", b"\0\1"), ("00020010", "UI", uid.encode()), ("00020012", "UI", IMPLEMENTATION_UID.encode()))
    body = b""
    for tag, vr, raw in own:
        raw += b"\0" * (len(raw) % 2)
        length = struct.pack("<HI", 0, len(raw)) if vr in V.LONG_FORM_VRS else struct.pack("<H", len(raw))
        body += struct.pack("<HH", int(tag[:4], 16), int(tag[4:], 16)) + vr.encode() + length + raw
    return bytes.fromhex(PREAMBLE + LENGTH_HEADER) + struct.pack("<I", len(body)) + body


_BYTES = bytes(range(256))
#: Columns that tell the forms of a header apart, so that one expression without branches writes them all.
_FORMS = {"_from": (1, 1, 7), "_size": (4, 6, 6), "_upper": (1, 0, 0), "_first": (0, 0, 8), "_second": (8, 8, 0), "_long_from": (1, 1, 9), "_long_size": (4, 8, 8), "_s0": (0, 0, 24), "_s1": (8, 8, 16), "_s2": (16, 16, 8), "_s3": (24, 24, 0)}


def _parts(tag: str, vr: str, value: Column) -> list[Column]:
    """The parts of an element's header, and its value; ``_FORMS`` are at hand, and a length of two bytes is known to hold the value's."""
    odd, group = F.length(value) % 2, (int(tag[:4], 16), int(tag[4:], 16))
    n = F.length(value) + odd
    padded = [value, F.substring(F.lit(b"\0" if vr in V.NUL_PADDED else b" "), F.lit(1), odd)]
    long = vr in V.LONG_FORM_VRS or vr not in V.KNOWN_VRS
    code = vr.encode() + b"\0\0" * long
    both = F.lit(struct.pack("<HH", *group) + code + struct.pack(">HH", *group) + code)
    byte = lambda shift, size: F.substring(F.lit(_BYTES), F.call_function("shiftright", n, shift).bitwiseAND(F.lit(255)) + 1, size)
    if long:
        return [F.substring(both, F.col("_long_from"), F.col("_long_size")), *[byte(F.col(f"_s{i}"), F.lit(1)) for i in range(4)], *padded]
    return [F.substring(both, F.col("_from"), F.col("_size")), byte(F.col("_first"), F.lit(1)), byte(F.col("_second"), F.lit(1)), byte(F.lit(16), F.col("_upper")), byte(F.lit(24), F.col("_upper")), *padded]


def serialize_columns(objects: DataFrame, fields: list[tuple[str, str, Column]], syntax: Column, syntaxes: tuple[str, ...] = tuple(TRANSFER_SYNTAXES)) -> DataFrame:
    """``(object_id, content)`` of objects that are a row each: ``fields`` has tag, representation and bytes of the root elements, in order.

    The same bytes as :func:`serialize` of a row an element, without rows to meet again: nothing is shuffled, joined or grouped. ``syntax`` is the
    object's transfer syntax, one of ``syntaxes``; ``content`` is null where it is another, or where a value is too long for its header. A missing value is an empty one.
    """
    kinds = {uid: TRANSFER_SYNTAXES[uid] for uid in syntaxes}
    names = [f"_v{i}" for i in range(len(fields))]
    of = lambda *own: F.coalesce(F.col("_syntax").isin(*[u for u, k in kinds.items() if k in own]), F.lit(False))
    rows = objects.select("object_id", syntax.alias("_syntax"), *[F.coalesce(raw, F.lit(b"")).alias(n) for n, (_, _, raw) in zip(names, fields, strict=True)])
    rows = rows.withColumn("_form", F.when(of("implicit-le"), 0).when(of("explicit-be"), 2).otherwise(1))
    form = [F.when(F.col("_form") == 0, i).when(F.col("_form") == 1, e).otherwise(b).alias(c) for c, (i, e, b) in _FORMS.items()]
    rows = rows.select("object_id", "_syntax", *form, *names)
    short = [F.length(n) for n, (_, vr, _) in zip(names, fields, strict=True) if vr in V.KNOWN_VRS and vr not in V.LONG_FORM_VRS]
    # a function over an array, as beside it the parts are compiled as many small methods, not as one that is too long to be compiled to machine code
    fits = (F.col("_upper") == 1) | F.forall(F.array(*short).cast("array<int>"), lambda n: n < 0xFFFF)
    parts = [x for n, (tag, vr, _) in zip(names, fields, strict=True) for x in _parts(tag, vr, F.col(n))]
    rows = rows.select("object_id", "_syntax", F.concat(*parts).alias("_body"), fits.alias("_fits"))
    rows = rows.select("object_id", "_syntax", F.when(F.col("_fits"), F.col("_body")).alias("_body"))
    packed = of("deflated-le")
    if "deflated-le" in kinds.values():
        rows = rows.withColumn("_body", F.when(packed, _deflated(F.when(packed, F.col("_body")))).otherwise(F.col("_body")))
    head = F.lit(None).cast("binary")
    for uid in kinds:
        head = F.when(F.col("_syntax") == uid, F.lit(_head_of(uid))).otherwise(head)
    return rows.select("object_id", F.concat(head, F.col("_body")).alias("content"))
