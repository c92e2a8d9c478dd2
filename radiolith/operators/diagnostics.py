"""Warnings and errors as tables; what a profile escalates or suppresses as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolith.functions import values as V
from radiolith.functions.charset import WITHHELD

# Warning codes and what each says here.
MESSAGES = {
    "BOM_IN_TEXT_VR": "a byte order mark begins a text value",
    "BURNED_IN_ANNOTATION_NOT_REMOVED": "pixel data may show identity; pixels are not changed",
    "CHARSET_AMBIGUOUS_SEPARATOR": "a separator byte may be part of a character",
    "DA_LEGACY_FORMAT": "a date is in the dotted form or no date",
    "DEIDENT_EMBEDDED_ATTRIBUTE_REMOVED": "the value of {tag} held encoded attributes and was emptied",
    "DEIDENT_METHOD_NOT_ADDED": "the de-identification method could not be added",
    "DEIDENT_METHOD_NOT_LO": "the prior de-identification method was not LO",
    "DEIDENT_METHOD_PRIOR_RETAINED": "a prior de-identification method was kept",
    "DEIDENT_METHOD_VALUE_OVER_LENGTH": "a de-identification method value exceeds 64 bytes",
    "DEIDENT_PRIVATE_CARRIER_NOT_AUDITABLE": "a private element's content cannot be audited",
    "DEIDENT_SEQUENCE_NOT_AUDITABLE": "the items of {tag} cannot be audited; it was emptied",
    "DEIDENT_UNDEFINED_VR_NOT_AUDITABLE": "{tag} has no defined representation; it was emptied",
    "DT_NONSTANDARD_OFFSET": "a date-time offset is out of form or range",
    "DUPLICATE_FILE_META_ELEMENT": "a file meta element occurs again; the first counts",
    "DUPLICATE_TAG_IN_DATA_SET": "{tag} occurs again; the last counts",
    "EMPTY_ITEM_IN_SEQUENCE": "an item is empty",
    "FILE_META_GROUP_LENGTH_MISMATCH": "the file meta group length differs from its extent",
    "FILE_META_GROUP_LENGTH_MISSING": "the file meta group has no length",
    "GROUP_LENGTH_IN_DATASET": "{tag} is a group length in the data set",
    "IMPLICIT_VR_FOR_PRIVATE_TAG_WITHOUT_VR": "a private element has no known representation",
    "IS_NONINTEGER_VALUE": "an integer string is no integer",
    "ITEM_CROSSES_SEQUENCE_END": "an item ends after its sequence",
    "MISSING_PREAMBLE": "the file has no preamble",
    "NONZERO_RESERVED_BYTES": "reserved bytes of {tag} are not zero",
    "NON_ASCII_IN_ASCII_VR": "a value that must be ASCII is not",
    "ODD_LENGTH_VALUE_PADDED": "{tag} has an odd length",
    "PIXEL_DATA_LENGTH_MISMATCH": "pixel data has another length than the image needs",
    "PRIVATE_CREATOR_UNKNOWN": "no profile knows a private creator",
    "PRIVATE_TAG_NO_CREATOR": "a private element's block is not reserved",
    "SQ_NOT_DESCENDED": "the items of {tag} could not be read",
    "TRAILING_NULL_IN_TEXT_VR": "a text value is padded with NUL",
    "UI_TRAILING_SPACE": "a UID is padded with a space",
    "UNDEFINED_LENGTH_IN_EXPLICIT_VR": "{tag} has an undefined length",
    "UNSUPPORTED_CHARSET": "a character set is not known",
    "UN_PARSED_AS_SQ": "{tag} of unknown representation was read as a sequence",
    "VR_MISMATCH": "{tag} is of {vr}, not of the registered representation",
}
CODES = frozenset(MESSAGES)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(MESSAGES.items()), "code string, template string")


def render(warnings: DataFrame, table: DataFrame, attributes: DataFrame) -> DataFrame:
    """Adds ``message``; a tag outside the registry and an unknown representation are withheld."""
    t = F.broadcast(table.select(F.col("code").alias("_c"), "template"))
    a = F.broadcast(attributes.select(F.col("tag").alias("_t")))
    out = warnings.join(t, F.col("code") == F.col("_c"), "left").join(a, F.col("tag") == F.col("_t"), "left")
    tag = F.coalesce("_t", F.lit(WITHHELD))
    vr = F.when(V.is_recognized_vr(F.col("vr")), F.col("vr")).otherwise(F.lit(WITHHELD))
    return out.select(*warnings.columns, F.replace(F.replace("template", F.lit("{tag}"), tag), F.lit("{vr}"), vr).alias("message"))


def apply_profile(warnings: DataFrame, escalate: frozenset[str] = frozenset(), suppress: frozenset[str] = frozenset(), strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(kept, fatal)``: under ``strict`` all are fatal; else suppressed ones go, and escalated ones are fatal."""
    if strict:
        return warnings.where("false"), warnings
    left = warnings.where(~F.col("code").isin(*suppress)) if suppress else warnings
    return (left.where(~F.col("code").isin(*escalate)), left.where(F.col("code").isin(*escalate))) if escalate else (left, left.where("false"))


def structural_warnings(elements: DataFrame) -> DataFrame:
    """Odd lengths and group lengths within a data set, from the element table."""
    code = F.array_compact(F.array(F.when(F.col("length") % 2 == 1, "ODD_LENGTH_VALUE_PADDED"), F.when((F.substring("tag", 5, 4) == "0000") & (F.substring("tag", 1, 4) != "0002"), "GROUP_LENGTH_IN_DATASET")))
    return elements.select("object_id", "ord", "tag", "vr", F.explode(code).alias("code"))


def vr_mismatches(elements: DataFrame, attributes: DataFrame) -> DataFrame:
    """Standard elements whose representation is not the registered one."""
    a = F.broadcast(attributes.select(F.col("tag").alias("_t"), F.col("vr").alias("registered")))
    return elements.join(a, F.col("tag") == F.col("_t")).where(F.col("vr") != F.col("registered")).select("object_id", "ord", "tag", "vr", "registered")


def value_warnings(vr: Column, value: Column) -> Column:
    """Codes that the decoding of one value gives, in order of code."""
    text = vr.isin(*V.TEXTS, *V.CHARSET_LISTS, "PN")
    found = [
        (text & value.startswith("﻿"), "BOM_IN_TEXT_VR"),
        ((vr == "DA") & F.exists(V.tokens(value), lambda t: V.parse_date(t)["legacy"]), "DA_LEGACY_FORMAT"),
        ((vr == "DT") & F.exists(V.tokens(value), lambda t: V.parse_date_time(t)["odd_offset"]), "DT_NONSTANDARD_OFFSET"),
        ((vr == "IS") & F.exists(V.tokens(value), lambda t: (t != "") & V.integer_string(t).isNull()), "IS_NONINTEGER_VALUE"),
        (vr.isin(*V.ASCII_LISTS, "UR", "DA", "TM", "DT", "DS", "IS") & V.non_ascii(value), "NON_ASCII_IN_ASCII_VR"),
        ((vr != "UI") & ~vr.isin(*V.BINARY) & V.trailing_null(value), "TRAILING_NULL_IN_TEXT_VR"),
        ((vr == "UI") & V.ui_trailing_space(value), "UI_TRAILING_SPACE"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in found]))


def _number(tag: str) -> Column:
    """The first number of a root element of each object: of two bytes, or an integer string."""
    here = (F.col("path") == "") & (F.col("tag") == tag)
    own = F.when(F.col("vr") == "US", F.get(V.binary_integers(F.col("raw"), 2, False, F.coalesce("little_endian", F.lit(True))), 0)).otherwise(V.integer_string(F.get(F.split(V.ascii_text(F.col("raw")), r"\\"), 0)))
    return F.max(F.when(here, own)).cast("long")


def pixel_length_mismatches(elements: DataFrame) -> DataFrame:
    """``(object_id, code, expected, length)`` of objects whose pixel data has another length than rows, columns, samples, bits and frames give.

    The length is that of whole bytes, made even; samples and frames are one where they are not said. Encapsulated pixel data has no such length, and an object without rows, columns or
    bits none to compare with. One aggregate an object. Needs ``little_endian``.
    """
    pixel = (F.col("path") == "") & F.col("tag").isin("7FE00010", "7FE00008", "7FE00009")
    framed = pixel & (F.col("item_count").isNotNull() | (F.col("length") == 0xFFFFFFFF))
    at = elements.groupBy("object_id").agg(
        _number("00280010").alias("rows"), _number("00280011").alias("columns"), _number("00280002").alias("samples"), _number("00280100").alias("bits"), _number("00280008").alias("frames"),
        F.max(F.when(pixel, F.length("raw"))).cast("long").alias("length"), F.coalesce(F.bool_or(framed), F.lit(False)).alias("framed"),
    )
    bits = F.col("rows") * F.col("columns") * F.coalesce("samples", F.lit(1)) * F.col("bits") * F.greatest(F.coalesce("frames", F.lit(1)), F.lit(1))
    expected = F.floor((F.floor((bits + 7) / 8) + 1) / 2) * 2
    return at.where(~F.col("framed")).select("object_id", F.lit("PIXEL_DATA_LENGTH_MISMATCH").alias("code"), expected.cast("long").alias("expected"), "length").where("length <> expected")


#: Character sets whose characters may have a backslash's byte: as the second of two bytes, or between escapes to sets of two bytes.
SECOND_BYTE = r"^(?:[\x00-\x80\xFF]|[\x81-\xFE][^\\])*+[\x81-\xFE]\\"
BETWEEN_ESCAPES = r"\x1B\$[()]?[@-D][^\x1B]*\\"


def ambiguous_separator(raw: Column, terms: Column) -> Column:
    """Whether a backslash's byte in a value may be part of a character, by the character sets in force; bytes are followed from the start of the value."""
    text = V.ascii_text(raw)
    two = F.coalesce(F.arrays_overlap(terms, F.array(F.lit("GB18030"), F.lit("GBK"))), F.lit(False))
    escaped = F.coalesce(F.exists(terms, lambda t: t.startswith("ISO 2022 IR ")), F.lit(False))
    return F.coalesce((two & text.rlike(SECOND_BYTE)) | (escaped & text.rlike(BETWEEN_ESCAPES)), F.lit(False))


def separator_warnings(elements: DataFrame) -> DataFrame:
    """``(object_id, ord, tag, vr, code)`` of texts that a separator may cut within a character. Needs ``charset``."""
    texts = F.col("vr").isin(*V.CHARSET_LISTS, "PN")
    rows = elements.where(texts & ambiguous_separator(F.col("raw"), F.col("charset")))
    return rows.select("object_id", "ord", "tag", "vr", F.lit("CHARSET_AMBIGUOUS_SEPARATOR").alias("code"))


def capped(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], most: int) -> DataFrame:
    """The first ``most`` rows of each group: a report's cap, which is never a cap on what is done."""
    from pyspark.sql import Window

    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")
