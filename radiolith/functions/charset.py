"""Specific character sets: terms, which of them are known, and text in them."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .values import strip_pad

WITHHELD = "<withheld>"

# Defined terms and the decoders for them.
LABELS = {
    "ISO_IR 100": "latin1", "ISO_IR 101": "iso8859-2", "ISO_IR 109": "iso8859-3", "ISO_IR 110": "iso8859-4", "ISO_IR 144": "iso8859-5", "ISO_IR 127": "iso8859-6", "ISO_IR 126": "iso8859-7", "ISO_IR 138": "iso8859-8", "ISO_IR 148": "iso8859-9",
    "ISO_IR 203": "iso8859-15", "ISO_IR 13": "shift_jis", "ISO_IR 166": "tis-620", "ISO_IR 192": "utf-8", "ISO_IR 6": "latin1", "GB18030": "gb18030", "GBK": "gbk",
    "ISO 2022 IR 6": "latin1", "ISO 2022 IR 100": "latin1", "ISO 2022 IR 101": "iso8859-2", "ISO 2022 IR 109": "iso8859-3", "ISO 2022 IR 110": "iso8859-4", "ISO 2022 IR 144": "iso8859-5", "ISO 2022 IR 127": "iso8859-6", "ISO 2022 IR 126": "iso8859-7",
    "ISO 2022 IR 138": "iso8859-8", "ISO 2022 IR 148": "iso8859-9", "ISO 2022 IR 203": "iso8859-15", "ISO 2022 IR 13": "shift_jis", "ISO 2022 IR 166": "tis-620",
    "ISO 2022 IR 87": "iso-2022-jp", "ISO 2022 IR 159": "iso-2022-jp", "ISO 2022 IR 149": "euc-kr", "ISO 2022 IR 58": "gb2312",
}
MULTIBYTE = ("iso-2022-jp", "euc-kr", "gb2312")


def parse_terms(value: Column) -> Column:
    """Terms of a character set element, trimmed; an empty first term stays."""
    return F.transform(F.split(strip_pad(value), r"\\"), lambda x: F.trim(x))


def is_known_term(term: Column) -> Column:
    return (term == "") | term.isin(*LABELS)


def withhold_unknown(terms: Column) -> Column:
    """Terms with the unknown ones replaced, as they may hold what must not be shown."""
    return F.transform(terms, lambda t: F.when(is_known_term(t), t).otherwise(F.lit(WITHHELD)))


def decoder_label(terms: Column) -> Column:
    """The decoder for a list of terms: a multi-byte one if there is one, else the first known, else Latin-1."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    labels = F.filter(F.transform(F.filter(terms, lambda t: t.isin(*LABELS)), lambda t: F.element_at(known, t)), lambda x: x.isNotNull())
    wide = F.filter(labels, lambda x: x.isin(*MULTIBYTE))
    return F.coalesce(F.get(wide, 0), F.get(labels, 0), F.lit("latin1"))


@functools.lru_cache(1024)
def label_of(terms: tuple[str, ...]) -> str:
    """:func:`decoder_label` of terms in Python."""
    labels = [LABELS[t] for t in terms if t in LABELS]
    return next((x for x in labels if x in MULTIBYTE), labels[0] if labels else "latin1")


def decode_bytes(raw: bytes | None, label: str | None) -> str | None:
    """Bytes by decoder label; malformed bytes become U+FFFD, a byte order mark at the start goes, an unknown label is read as UTF-8."""
    if raw is None:
        return None
    try:
        return bytes(raw).decode(label or "latin1", errors="replace").removeprefix("\ufeff")
    except LookupError:
        return bytes(raw).decode(errors="replace").removeprefix("\ufeff")


@F.pandas_udf(StringType())
def decode_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """:func:`decode_bytes` in batches."""
    for raw, label in batches:
        yield pd.Series([decode_bytes(r, x) for r, x in zip(raw, label, strict=True)], dtype=object)
