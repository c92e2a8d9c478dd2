"""Value representations decoded with column expressions.

A malformed value becomes null, or a struct with ``valid`` false, and never a plausible value. Nothing here
raises on wire text: casts are guarded by a pattern first. Patterns end in ``\\z``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: representations by how their bytes are read.
ASCII_LISTS = ("AE", "CS", "AS", "UI")
CHARSET_LISTS = ("LO", "SH", "UC")
CHARSET_TEXTS = ("LT", "ST", "UT")
TEXTS = (*CHARSET_TEXTS, "UR")
BINARY = ("OB", "OD", "OF", "OL", "OV", "OW", "UN")
NUMBERS = ("US", "UL", "SS", "SL", "FL", "FD")
BIGINTS = ("SV", "UV")
KNOWN_VRS = ("AE", "AS", "AT", "CS", "DA", "DS", "DT", "FD", "FL", "IS", "LO", "LT", "OB", "OD", "OF", "OL", "OV", "OW", "PN", "SH", "SL", "SQ", "SS", "ST", "SV", "TM", "UC", "UI", "UL", "UN", "UR", "US", "UT", "UV")
LONG_FORM_VRS = ("OB", "OW", "OF", "OD", "OL", "OV", "SQ", "UT", "UN", "UC", "UR", "SV", "UV")
STRIDE_2, STRIDE_4, STRIDE_8 = ("AT", "US", "SS", "OW"), ("UL", "SL", "FL", "OF", "OL"), ("FD", "OD", "OV", "SV", "UV")
NUL_PADDED = ("UI", "OB", "OW", "OF", "OD", "OL", "OV", "UN")

#: White space that the temporal and numeric strings drop at both ends.
_WIDE_SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def is_recognized_vr(vr: Column) -> Column:
    return vr.isin(*KNOWN_VRS)


def is_long_form(vr: Column) -> Column:
    """Whether an explicit header takes 12 bytes; an unknown representation does."""
    return vr.isin(*LONG_FORM_VRS) | ~is_recognized_vr(vr)


def stride(vr: Column) -> Column:
    """Bytes of a unit that big-endian data swaps; 0 for none."""
    return F.when(vr.isin(*STRIDE_2), 2).when(vr.isin(*STRIDE_4), 4).when(vr.isin(*STRIDE_8), 8).otherwise(0)


def kind(vr: Column, length: Column) -> Column:
    """The kind of decoded value of an element."""
    return (
        F.when(vr == "SQ", "sequence").when(vr.isin(*BINARY), "binary").when(length == 0, "empty").when(vr.isin(*NUMBERS), "numbers").when(vr.isin(*BIGINTS), "bigints")
        .when(vr == "AT", "attributeTags").when(vr == "PN", "personName").when(vr.isin(*ASCII_LISTS, *CHARSET_LISTS), "strings").when(vr.isin(*TEXTS), "text")
        .when(vr == "DS", "decimalString").when(vr == "IS", "integerString").when(vr == "DA", "dates").when(vr == "TM", "times").when(vr == "DT", "dateTimes").otherwise("binary")
    )


def strip_pad(value: Column) -> Column:
    """Without the spaces and NULs at the end."""
    return F.rtrim(value, F.lit(" \x00"))


def ui_trailing_space(value: Column) -> Column:
    """A UI value that is padded with a space."""
    return value.endswith(" ")


def trailing_null(value: Column) -> Column:
    """A text value that is padded with NUL."""
    return value.endswith("\x00")


def ascii_text(raw: Column) -> Column:
    """Bytes as Latin-1, which keeps each byte apart."""
    return F.decode(raw, "ISO-8859-1")


def non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def strip_bom(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit("\ufeff")), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def split_values(value: Column) -> Column:
    """Values of a backslash-separated list, spaces alone trimmed at both ends."""
    return F.transform(F.split(strip_pad(value), r"\\"), lambda x: F.trim(x))


def first_value(value: Column) -> Column:
    """The first of :func:`split_values`."""
    return F.trim(F.get(F.split(strip_pad(value), r"\\"), 0))


def first_token(value: Column) -> Column:
    """The first of :func:`tokens`."""
    return wide_trim(F.get(F.split(strip_pad(value), r"\\"), 0))


def wide_trim(value: Column) -> Column:
    return F.btrim(value, F.lit(_WIDE_SPACE))


def tokens(value: Column) -> Column:
    """Values of a list with any white space trimmed at both ends."""
    return F.transform(F.split(strip_pad(value), r"\\"), wide_trim)


def decimal_string(token: Column) -> Column:
    """DS: a finite double, or null."""
    number = F.when(token.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), token.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def integer_string(token: Column) -> Column:
    """IS: a 64-bit integer, or null."""
    return F.when(token.rlike(r"^[+-]?[0-9]+\z"), token.try_cast("bigint"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it; else its code would be repeated beyond what compiles."""
    return F.get(F.transform(F.array(value), body), 0)


def _part(digits: Column, at: int, size: int) -> Column:
    """``size`` digits from a place on as a number, if there are so many."""
    return F.when(F.length(digits) >= at + size - 1, F.substring(digits, at, size)).try_cast("int")


def _fraction(text: Column) -> Column:
    """What follows the point, as a fraction."""
    return F.when(F.contains(text, F.lit(".")), F.concat(F.lit("0."), F.substring_index(text, ".", -1))).try_cast("double")


DATE = r"^(?:[0-9]{8}|[0-9]{4}\.[0-9]{2}\.[0-9]{2})\z"


def parse_date(raw: Column) -> Column:
    """DA: ``raw, valid, legacy, year, month, day``. The day may be up to 31 in any month; what is not eight digits is legacy."""

    def parts(r: Column) -> Column:
        digits = F.when(r.rlike(DATE), F.replace(r, F.lit("."), F.lit("")))
        names = {"year": (1, 4), "month": (5, 2), "day": (7, 2)}
        return F.struct(r.alias("raw"), *[_part(digits, *at).alias(n) for n, at in names.items()])

    def checked(p: Column) -> Column:
        valid = F.coalesce(p["month"].between(1, 12) & p["day"].between(1, 31), F.lit(False))
        legacy = (p["raw"] != "") & ~p["raw"].rlike(r"^[0-9]{8}\z")
        return F.struct(p["raw"].alias("raw"), valid.alias("valid"), legacy.alias("legacy"), *[F.when(valid, p[n]).alias(n) for n in ("year", "month", "day")])

    return let(raw, lambda r: let(parts(r), checked))


TIME = r"^([0-9]{2})([0-9]{2})?([0-9]{2})?(\.[0-9]+)?\z"


def parse_time(raw: Column) -> Column:
    """TM: ``raw, valid, hours, minutes, seconds, fraction``; second 60 is allowed."""

    def parts(r: Column) -> Column:
        body = F.when(r.rlike(TIME), r)
        digits = F.substring_index(body, ".", 1)
        return F.struct(r.alias("raw"), *[_part(digits, at, 2).alias(n) for n, at in (("hours", 1), ("minutes", 3), ("seconds", 5))], _fraction(body).alias("fraction"))

    def checked(p: Column) -> Column:
        fine = lambda n, most: F.coalesce(p[n].between(0, most), F.lit(True))
        valid = p["hours"].isNotNull() & fine("hours", 23) & fine("minutes", 59) & fine("seconds", 60)
        return F.struct(p["raw"].alias("raw"), valid.alias("valid"), *[F.when(valid, p[n]).alias(n) for n in ("hours", "minutes", "seconds", "fraction")])

    return let(raw, lambda r: let(parts(r), checked))


DATE_TIME = r"^([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?(\.[0-9]+)?\z"
OFFSET = r"^[+-][0-9]{4}\z"


def parse_date_time(raw: Column) -> Column:
    """DT: date and time parts of any precision, ``offset_minutes``, and ``odd_offset`` for an offset out of form or range.

    The offset begins at the first plus or the first minus after the first character, whichever is later. Before what
    is no date and time no offset is odd.
    """
    places = {"year": (1, 4), "month": (5, 2), "day": (7, 2), "hours": (9, 2), "minutes": (11, 2), "seconds": (13, 2)}
    limits = {"month": (1, 12), "day": (1, 31), "hours": (0, 23), "minutes": (0, 59), "seconds": (0, 60)}

    def cut(r: Column) -> Column:
        at = F.greatest(F.locate("+", r, 2), F.locate("-", r, 2))
        body = F.when(at > 1, F.substring(r, F.lit(1), at - 1)).otherwise(r)
        return F.struct(r.alias("raw"), F.when(body.rlike(DATE_TIME), body).alias("body"), F.when(at > 1, F.substring(r, at, F.length(r))).alias("offset"))

    def parts(c: Column) -> Column:
        digits, hours = F.substring_index(c["body"], ".", 1), F.when(c["offset"].rlike(OFFSET), c["offset"])
        numbers = [_part(digits, *at).alias(n) for n, at in places.items()]
        return F.struct(c["raw"].alias("raw"), c["offset"].alias("offset"), *numbers, _fraction(c["body"]).alias("fraction"), _part(hours, 2, 2).alias("oh"), _part(hours, 4, 2).alias("om"))

    def checked(p: Column) -> Column:
        good = F.coalesce(p["oh"].between(0, 14) & p["om"].between(0, 59), F.lit(False))
        valid = p["year"].isNotNull()
        for n, (lo, hi) in limits.items():
            valid = valid & F.coalesce(p[n].between(lo, hi), F.lit(True))
        minutes = F.when(p["offset"].startswith("-"), -1).otherwise(1) * (p["oh"] * 60 + p["om"])
        values = [F.when(valid, p[n]).alias(n) for n in (*places, "fraction")]
        odd = p["offset"].isNotNull() & ~good & p["year"].isNotNull()
        return F.struct(p["raw"].alias("raw"), valid.alias("valid"), odd.alias("odd_offset"), *values, F.when(valid & good, minutes).alias("offset_minutes"))

    return let(raw, lambda r: let(cut(r), lambda c: let(parts(c), checked)))


_NAME_PARTS = ("family", "given", "middle", "prefix", "suffix")


def _name_group(text: Column) -> Column:
    parts = F.split(text, r"\^")
    return F.struct(*[F.coalesce(F.trim(F.get(parts, i)), F.lit("")).alias(n) for i, n in enumerate(_NAME_PARTS)])


def parse_person_name(value: Column) -> Column:
    """PN: ``alphabetic, ideographic, phonetic`` groups of five components; a group that is not there is null."""
    groups = F.split(value, "=")
    return F.struct(*[F.when(F.get(groups, i).isNotNull(), _name_group(F.get(groups, i))).alias(n) for i, n in enumerate(("alphabetic", "ideographic", "phonetic"))])


def pad_even(raw: Column, vr: Column) -> Column:
    """Bytes of even length: NUL after UI and binary values, else a space."""
    odd = F.length(raw) % 2 == 1
    return F.when(odd & vr.isin(*NUL_PADDED), F.concat(raw, F.unhex(F.lit("00")))).when(odd, F.concat(raw, F.unhex(F.lit("20")))).otherwise(raw)


def _unsigned(raw: Column, at: Column, size: int, little: Column) -> Column:
    chunk = F.hex(F.substring(raw, at, F.lit(size)))
    swapped = F.concat(*[F.substring(chunk, 2 * i - 1, 2) for i in range(size, 0, -1)])
    return F.conv(F.when(little, swapped).otherwise(chunk), 16, 10)


def binary_integers(raw: Column, size: int, signed: bool, little: Column) -> Column:
    """Whole units of ``size`` bytes (1 to 4 as long, 8 as decimal or long); a part of a unit at the end is left out."""
    n = F.floor(F.length(raw) / size).cast("int")
    if size == 8:
        full = lambda i: _unsigned(raw, (i * size + 1).cast("int"), size, little).cast("decimal(20,0)")
        limit, wrap = F.lit(2**63 - 1).cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    else:
        full = lambda i: _unsigned(raw, (i * size + 1).cast("int"), size, little).cast("bigint")
        limit, wrap = F.lit(2 ** (8 * size - 1) - 1).cast("bigint"), F.lit(2 ** (8 * size)).cast("bigint")
    plus = (lambda v: F.when(v > limit, v - wrap).otherwise(v).cast("bigint")) if signed else (lambda v: v)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: plus(full(i)))).otherwise(F.array().cast("array<decimal(20,0)>" if size == 8 and not signed else "array<bigint>"))


def floats(raw: Column, size: int, little: Column) -> Column:
    """Whole IEEE 754 units of 4 or 8 bytes as doubles, put together from sign, exponent and fraction."""
    halves = binary_integers(raw, 4, False, little)
    power = lambda n: F.pow(F.lit(2.0), n)

    def number(sign: Column, exponent: Column, fraction: Column, most: int, bits: int, bias: int) -> Column:
        value = F.when(exponent == most, F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        value = value.when(exponent == 0, fraction.cast("double") * power(F.lit(1 - bias - bits)))
        return F.when(sign == 1, -1.0).otherwise(1.0) * value.otherwise((fraction + F.lit(2**bits)).cast("double") * power(exponent - F.lit(bias + bits)))

    part = lambda u, shift, bits: F.shiftrightunsigned(u, shift).bitwiseAND(F.lit(2**bits - 1).cast("bigint"))
    if size == 4:
        return F.transform(halves, lambda u: number(part(u, 31, 1), part(u, 23, 8), part(u, 0, 23), 255, 23, 127))

    def one(i: Column) -> Column:
        a, b = F.get(halves, (2 * i).cast("int")), F.get(halves, (2 * i + 1).cast("int"))
        high, low = F.when(little, b).otherwise(a), F.when(little, a).otherwise(b)
        return number(part(high, 31, 1), part(high, 20, 11), part(high, 0, 20) * F.lit(2**32) + low, 2047, 52, 1023)

    n = F.floor(F.length(raw) / 8).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


def number_text(vr: Column, raw: Column, little: Column) -> Column:
    """The numbers of a binary numeric value (``NUMBERS``, ``BIGINTS`` or AT) as text, joined by backslashes; null for other representations."""
    join = lambda numbers: F.array_join(F.transform(numbers, lambda x: x.cast("string")), "\\")
    out = F.when(vr == "US", join(binary_integers(raw, 2, False, little))).when(vr == "SS", join(binary_integers(raw, 2, True, little)))
    out = out.when(vr == "UL", join(binary_integers(raw, 4, False, little))).when(vr == "SL", join(binary_integers(raw, 4, True, little)))
    out = out.when(vr == "UV", join(binary_integers(raw, 8, False, little))).when(vr == "SV", join(binary_integers(raw, 8, True, little)))
    return out.when(vr == "FL", join(floats(raw, 4, little))).when(vr == "FD", join(floats(raw, 8, little))).when(vr == "AT", F.array_join(attribute_tags(raw, little), "\\"))


def attribute_tags(raw: Column, little: Column) -> Column:
    """AT: tags of four bytes each, two 16-bit halves."""
    h = F.hex(raw)
    n = F.floor(F.length(raw) / 4).cast("int")

    def one(i: Column) -> Column:
        at = (i * 8).cast("int")
        b = [F.substring(h, at + 2 * k + 1, F.lit(2)) for k in range(4)]
        return F.when(little, F.concat(b[1], b[0], b[3], b[2])).otherwise(F.concat(*b))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<string>"))
