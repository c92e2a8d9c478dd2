"""Tags as eight upper-case hexadecimal digits, group before element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid_tag(tag: Column) -> Column:
    """Whether a string is a tag. ``\\z``, as ``$`` would also match before a last line feed."""
    return tag.rlike(r"^[0-9A-F]{8}\z")


def tag_group(tag: Column) -> Column:
    return F.conv(F.substring(tag, 1, 4), 16, 10).cast("int")


def tag_element(tag: Column) -> Column:
    return F.conv(F.substring(tag, 5, 4), 16, 10).cast("int")


def join_tag(group: Column, element: Column) -> Column:
    return F.concat(F.lpad(F.hex(group), 4, "0"), F.lpad(F.hex(element), 4, "0"))


def is_private_tag(tag: Column) -> Column:
    """Odd group: the fourth digit decides."""
    return F.substring(tag, 4, 1).isin(*"13579BDF")


def is_file_meta_tag(tag: Column) -> Column:
    return F.substring(tag, 1, 4) == "0002"


def is_private_creator_slot(tag: Column) -> Column:
    """``(gggg,0010)`` to ``(gggg,00FF)`` of an odd group."""
    return is_private_tag(tag) & F.substring(tag, 5, 4).between("0010", "00FF")


def private_block(tag: Column) -> Column:
    """The block that a private data element belongs to: the upper byte of its element number, or null below 10."""
    block = F.substring(tag, 5, 2)
    return F.when(is_private_tag(tag) & (block >= "10"), block)


def canonical_private_key(tag: Column) -> Column:
    """Group, ``XX`` for the block, low byte."""
    return F.concat(F.substring(tag, 1, 4), F.lit("XX"), F.substring(tag, 7, 2))
