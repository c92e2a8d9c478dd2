"""The flat element table: one row an element, nested items by path.

``elements(object_id, path, ord, tag, vr, length, raw, ...)``; ``path`` is a string of ``tag[item]`` steps joined by
``/``, empty at the root. All functions take and return DataFrames, and leave the order of work to Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolith.functions import charset as C
from radiolith.functions import tags as T
from radiolith.functions import values as V
from radiolith.functions.charset import WITHHELD

from . import nesting

KEY = ("object_id", "path")


def decoded(elements: DataFrame, label: str | None = None, read: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds ``value``: the text of ``raw`` by representation, byte order and character set.

    Binary numbers are written out, joined by backslashes. Text that depends on a character set is decoded by the element's own
    (``charset``, an array of terms), or by ``label`` for all: Latin-1 and UTF-8 in the JVM, others in Arrow batches, malformed bytes as
    U+FFFD. All else is Latin-1. ``read`` has each element's decoder label and, for labels beside those two, its text, where a parser knows them.
    """
    return elements.withColumn("value", _text(F.col, label, read))


def _text(of: Callable[[str], Column], label: str | None, read: tuple[Column, Column] | None) -> Column:
    """The text of :func:`decoded`; ``of`` gives an element's columns."""
    vr, raw = of("vr"), of("raw")
    text = vr.isin(*V.CHARSET_LISTS, *V.CHARSET_TEXTS, "PN")
    latin, utf8 = V.ascii_text(raw), V.strip_bom(F.call_function("make_valid_utf8", raw.cast("string")))
    if label == "utf-8":
        value = F.when(text, utf8).otherwise(latin)
    elif read:
        own, other = read
        value = F.when(text & (own == "utf-8"), utf8).when(text & (own != "latin1"), other).otherwise(latin)
    else:
        own = F.lit(label) if label else C.decoder_label(F.coalesce(of("charset"), F.array().cast("array<string>")))
        other = text & ~own.isin("latin1", "utf-8")
        value = F.when(other, C.decode_text(F.when(other, raw), F.when(other, own))).when(text & (own == "utf-8"), utf8).otherwise(latin)
    numbers = V.number_text(vr, raw, F.coalesce(of("little_endian"), F.lit(True)))
    return F.when(vr.isin(*V.NUMBERS, *V.BIGINTS, "AT"), numbers).otherwise(value)


def tagged(tags: Iterable[str], root: bool = True, elements: str = "elements") -> Column:
    """``array<struct<tag, value>>``: the decoded elements of ``tags`` of a row that holds a whole parsed file, so that nothing is exploded to meet again."""
    own = F.filter(elements, lambda e: e["tag"].isin(*tags) & (e["path"] == "") if root else e["tag"].isin(*tags))
    return F.transform(own, lambda e: F.struct(e["tag"].alias("tag"), _text(lambda name: e[name], None, (e["label"], e["text"])).alias("value")))


def get_tag(elements: DataFrame, tag: str) -> DataFrame:
    """The element of a tag, at the root and in any case of letters."""
    return elements.where((F.col("tag") == tag.upper()) & (F.col("path") == ""))


def has_tag(elements: DataFrame, tag: str) -> DataFrame:
    """``(object_id, present)`` for every object."""
    return elements.groupBy("object_id").agg(F.bool_or((F.col("tag") == tag.upper()) & (F.col("path") == "")).alias("present"))


def get_all(elements: DataFrame, tag: str, value: str = "value") -> DataFrame:
    """``(object_id, values)``: a list of one value or none."""
    hit = F.when((F.col("tag") == tag.upper()) & (F.col("path") == ""), F.col(value))
    return elements.groupBy("object_id").agg(F.collect_list(hit).alias("values"))


def items_of(elements: DataFrame, tag: str, parent: str = "") -> DataFrame:
    """Elements of the items of a sequence, with ``item``; deeper ones are left out."""
    prefix = (parent + "/" if parent else "") + tag
    pattern = "^" + prefix.replace("[", r"\[").replace("]", r"\]") + r"\[([0-9]+)\]\z"
    return elements.where(F.col("path").rlike(pattern)).withColumn("item", F.regexp_extract("path", pattern, 1).try_cast("int"))


def last_wins(elements: DataFrame, *values: str) -> DataFrame:
    """One element a tag of each data set: the last read has the value, the first the position. ``repeats`` counts the others."""
    picked = [F.max_by(F.col(v), F.col("ord")).alias(v) for v in values]
    return elements.groupBy(*KEY, "tag").agg(F.min("ord").alias("pos"), *picked, (F.count("*") - 1).alias("repeats"))


def first_wins(elements: DataFrame, *values: str) -> DataFrame:
    """File meta elements: the first copy of a tag counts."""
    return elements.groupBy("object_id", "tag").agg(*[F.min_by(F.col(v), F.col("ord")).alias(v) for v in values])


def file_meta_residue(elements: DataFrame, modeled: tuple[str, ...] = ("00020000", "00020001", "00020002", "00020003", "00020010", "00020012", "00020013", "00020016")) -> DataFrame:
    """File meta elements that no field of the typed view holds."""
    return elements.where(T.is_file_meta_tag(F.col("tag")) & ~F.col("tag").isin(*modeled))


def resolve_creators(elements: DataFrame, ordered: bool = True, value: str = "value") -> DataFrame:
    """Adds ``private_creator``, or replaces it: the creator that reserves an element's block in the same data set.

    ``ordered``: as a parser knows it, only a creator read before the element, the latest of several; else any, the last one.
    A block and its creator's slot are one window of their object, so that nothing is joined.
    """
    slot = T.is_private_creator_slot(F.col("tag"))
    named = F.when(slot & (F.trim(F.col(value)) != ""), F.trim(F.col(value)))
    whole = Window.partitionBy("object_id", "path", F.substring("tag", 1, 4), F.when(slot, F.substring("tag", 7, 2)).otherwise(T.private_block(F.col("tag"))))
    found = F.last(named, ignorenulls=True).over(whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)) if ordered else F.max_by(named, F.when(named.isNotNull(), F.col("ord"))).over(whole)
    return elements.withColumn("private_creator", F.when(T.private_block(F.col("tag")).isNotNull() & ~slot, found))


def safe_creator(creator: Column, known: Column) -> Column:
    """The creator as shown: only one that the profile names, else withheld."""
    return F.when(creator.isNull(), None).when(known, creator).otherwise(F.lit(WITHHELD))


def carried_charset(elements: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``charset``: the last character set element before a row in its data set, else that in force at the sequence that the row is in, over any depth."""
    return nesting.inherited(elements, F.when(F.col("tag") == "00080005", F.col(value)), "charset")


def overruns(elements: DataFrame, encoding: str = "encoding") -> Column:
    """Whether a sequence's items reach beyond the length that it declares; an undefined length declares none."""
    header = F.when(F.col(encoding) == "implicit-le", 0).otherwise(12)
    return F.coalesce((F.col("vr") == "SQ") & (F.col("length") != 0xFFFFFFFF) & (F.length("raw") - header > F.col("length")), F.lit(False))


def poisoned(elements: DataFrame, overruns: str = "overruns") -> DataFrame:
    """Adds ``poisoned``: whether an element lies in an item, however deep, of a sequence that its items overrun."""
    out = nesting.intervals(elements).withColumn("poisoned", nesting.inside(F.col(overruns)))
    return out.select(*elements.columns, "poisoned")


def settled(elements: DataFrame, overruns: str = "overruns") -> DataFrame:
    """Adds ``settled``: whether an element stands at or before the first sequence whose items overrun it, in order and by offset."""
    whole = Window.partitionBy(*KEY)
    bad = F.min(F.when(F.col(overruns), F.col("ord"))).over(whole)
    at = F.min(F.when(F.col(overruns), F.col("byte_offset"))).over(whole)
    return elements.withColumn("settled", F.coalesce((F.col("ord") <= bad) & (F.col("byte_offset") <= at), F.lit(True)))
