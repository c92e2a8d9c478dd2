"""Registries as small dimension tables, and lookups as left joins against them.

They are plain text files, one row a line, in ``radiolith/data``; every function takes the path of another. The actions and UIDs
are the whole published tables: 652 tags and 3 masks, 494 UIDs. The built-in attributes are those that the views, the
de-identification and the profiles need; the published registry is larger and can be given in the same form.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolith.functions import tags as T

TRANSFER_SYNTAXES = {"1.2.840.10008.1.2": "implicit-le", "1.2.840.10008.1.2.1": "explicit-le", "1.2.840.10008.1.2.2": "explicit-be", "1.2.840.10008.1.2.1.99": "deflated-le"}

#: Content sequence of structured reports, see ``actions``.
CONTENT = "0040A730"
#: First byte of the repeating groups; the second is even, 00 to 1E.
REPEATING = {"50": "Curves (retired)", "60": "Overlay Planes"}
CODING_SCHEMES = {"DCM": "1.2.840.10008.2.16.4", "SCT": "2.16.840.1.113883.6.96", "UCUM": "2.16.840.1.113883.6.8", "LN": "2.16.840.1.113883.6.1"}


DATA = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "data")


def _lines(name: str, path: str | None = None) -> list[str]:
    with open(path or os.path.join(DATA, f"{name}.txt"), encoding="utf-8") as f:
        return [x for x in f.read().splitlines() if x and x[0] != "#"]


def attribute_rows(path: str | None = None) -> list[tuple[str, str, str]]:
    """``(tag, vr, keyword)`` of a registry file: of the one given, of any size, or of the built-in one."""
    return [tuple(x.split(" ", 2)) for x in _lines("attributes", path)]


def vr_of(path: str | None = None) -> dict[str, str]:
    return {t: v for t, v, _ in attribute_rows(path)}


def family_rows(path: str | None = None) -> list[tuple[str, str, str]]:
    """``(pattern, vr, keyword)`` of the families of repeating groups; ``x`` stands for any hexadecimal digit."""
    return [tuple(x.split(" ", 2)) for x in _lines("families", path)]


def mask_rows(path: str | None = None) -> list[tuple[str, str, str]]:
    """``(pattern, basic, option)`` of the actions on repeating groups."""
    return [tuple(x.split(" ", 2)) for x in _lines("masks", path)]


def action_rows(path: str | None = None) -> list[tuple[str, str, dict[str, str]]]:
    return [(tag, basic, dict(x.split("=") for x in over)) for tag, basic, *over in (x.split(" ") for x in _lines("actions", path))]


def repeating_groups(prefix: str) -> list[str]:
    """The 16 groups of a repeating prefix."""
    return [f"{prefix}{low:02X}" for low in range(0, 0x1F, 2)] if prefix in REPEATING else []


def expand_mask(pattern: str) -> list[str]:
    """The tags that a mask with a fixed element covers, or the groups of one with any element."""
    groups = repeating_groups(pattern[:2])
    return groups if pattern.endswith("xxxx") else [g + pattern[4:] for g in groups]


def attributes(spark: SparkSession, path: str | None = None) -> DataFrame:
    return spark.createDataFrame(attribute_rows(path), "tag string, vr string, keyword string")


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(family_rows(), "pattern string, vr string, keyword string")


def uids(spark: SparkSession, path: str | None = None) -> DataFrame:
    return spark.createDataFrame([tuple(x.split("|")) for x in _lines("uids", path)], "uid string, type string, name string")


def actions(spark: SparkSession, content: bool = True) -> DataFrame:
    """``(tag, basic, options)``; the masks with a fixed element are expanded, so that they meet by equality too.

    The published table empties the content sequence of all that is in it. Without ``content`` it stays, and each element in it
    has its own action.
    """
    rows = [r for r in action_rows() if content or r[0] != CONTENT]
    for r in mask_rows():
        pattern, basic, option = r
        if not pattern.endswith("xxxx"):
            rows += [(t, basic, dict([option.split("=")])) for t in expand_mask(pattern)]
    return spark.createDataFrame(rows, "tag string, basic string, options map<string,string>")


def masked_groups(spark: SparkSession) -> DataFrame:
    """``(grp, basic, options)`` of the masks that cover whole groups."""
    rows = [(g, r[1], dict([r[2].split("=")])) for r in mask_rows() if r[0].endswith("xxxx") for g in expand_mask(r[0])]
    return spark.createDataFrame(rows, "grp string, basic string, options map<string,string>")


def matches_mask(pattern: Column, tag: Column) -> Column:
    """Whether a bounded mask covers a tag: its prefix, an even second byte up to 1E, the element exactly or any."""
    low = F.conv(F.substring(tag, 3, 2), 16, 10).cast("int")
    element = F.substring(pattern, 5, 4)
    return F.substring(pattern, 1, 2).isin(*REPEATING) & (F.substring(pattern, 1, 2) == F.substring(tag, 1, 2)) & (low % 2 == 0) & (low <= 0x1E) & ((element == "xxxx") | (element == F.substring(tag, 5, 4)))


def shape(pattern: Column) -> Column:
    """Where a pattern has wildcards: its digits as ``0``."""
    return F.regexp_replace(pattern, "[0-9A-F]", "0")


def match_patterns(df: DataFrame, tag: Column, table: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``: ``value`` of the pattern of ``table`` that covers ``tag``, with ``x`` for any digit at any place.

    Of several patterns the one with the fewest wildcards counts, then the one whose first ones come last. A tag with its digits blanked where a pattern has wildcards is
    equal to the pattern: so each shape of pattern is one equality join, and there are as many as there are shapes, whatever the number of patterns.
    """
    shapes = [r["s"] for r in table.select(shape(F.col("pattern")).alias("s")).distinct().collect()]  # rows of the registry, 256 at most
    out, found = df, []
    for k, s in enumerate(sorted(shapes, key=lambda s: (s.count("x"), s))):
        masked = F.concat(*[F.lit("x") if c == "x" else F.substring(tag, i + 1, 1) for i, c in enumerate(s)])
        own = table.where(shape(F.col("pattern")) == s).groupBy(F.col("pattern").alias(f"_p{k}")).agg(F.min(value).alias(f"_m{k}"))
        out = out.join(F.broadcast(own), masked == F.col(f"_p{k}"), "left")
        found.append(F.col(f"_m{k}"))
    return out.select(*df.columns, (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))


def lookup(df: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """Adds ``tag, vr, keyword`` of a column that holds tags (any case) or keywords (exact case); nulls if unknown."""
    by_tag = F.broadcast(table.select(F.col("tag").alias("_t"), F.col("vr").alias("_v"), F.col("keyword").alias("_k")))
    by_word = F.broadcast(table.select(F.col("tag").alias("_t2"), F.col("vr").alias("_v2"), F.col("keyword").alias("_k2")))
    out = df.join(by_tag, F.upper(F.col(name)) == F.col("_t"), "left").join(by_word, F.col(name) == F.col("_k2"), "left")
    return out.select(*df.columns, F.coalesce("_t", "_t2").alias("tag"), F.coalesce("_v", "_v2").alias("vr"), F.coalesce("_k", "_k2").alias("keyword"))


def lookup_uid(df: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """Adds ``uid_type, uid_name``; padding at the end does not count."""
    t = F.broadcast(table.select(F.col("uid").alias("_u"), F.col("type").alias("uid_type"), F.col("name").alias("uid_name")))
    return df.join(t, F.regexp_replace(F.col(name), r"[ \x00]+\z", "") == F.col("_u"), "left").drop("_u")


def transfer_syntax(uid: Column) -> Column:
    """The parser for a transfer syntax, or null: such a file is an error."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in TRANSFER_SYNTAXES.items():
        out = out.when(uid == k, v)
    return out


def resolve_implicit_vr(df: DataFrame, table: DataFrame, family: DataFrame, private: DataFrame | None = None) -> DataFrame:
    """Adds ``resolved_vr`` for ``tag`` (and ``private_creator`` with a ``private(creator, key, vr)`` table).

    In order: a private creator slot is LO; another private tag has its profile's representation, else UN; a
    standard tag its registered one; then that of a repeating family; else UN.
    """
    t = F.broadcast(table.select(F.col("tag").alias("_t"), F.col("vr").alias("_v")))
    tag = F.col("tag")
    out = match_patterns(df.join(t, tag == F.col("_t"), "left"), tag, family, "vr", "_fv")
    own = F.lit(None).cast("string")
    if private is not None:
        p = F.broadcast(private.select(F.col("creator").alias("_c"), F.col("key").alias("_key"), F.col("vr").alias("_pv")))
        out = out.join(p, (F.col("private_creator") == F.col("_c")) & (T.canonical_private_key(tag) == F.col("_key")), "left")
        own = F.col("_pv")
    vr = F.when(T.is_private_creator_slot(tag), "LO").when(T.is_private_tag(tag), F.coalesce(own, F.lit("UN"))).otherwise(F.coalesce("_v", "_fv", F.lit("UN")))
    return out.select(*df.columns, vr.alias("resolved_vr"))


def overlay(normative: DataFrame, mirror: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field-wise overlay of two registries: the normative source wins wherever it has a value."""
    a = normative.select(F.col(key).alias("_ka"), *[F.col(f).alias("_a_" + f) for f in fields])
    b = mirror.select(F.col(key).alias("_kb"), *[F.col(f).alias("_b_" + f) for f in fields])
    met = a.join(b, F.col("_ka") == F.col("_kb"), "full_outer")
    return met.select(F.coalesce("_ka", "_kb").alias(key), *[F.coalesce("_a_" + f, "_b_" + f).alias(f) for f in fields])
