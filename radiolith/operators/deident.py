"""De-identification of the element table by a rule table, with a full audit.

Rules meet the elements by broadcast joins. What a removed sequence takes with it is told by paths alone or, where private elements
are retained, by one sweep over the intervals of sequences. An object's rows come together once, for what is added to it.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from radiolith.functions import tags as T
from radiolith.functions import uids as U
from radiolith.functions import values as V

from . import dictionary as D
from . import nesting
from .elements import overruns, poisoned, resolve_creators, settled
from .embedded import SCANNABLE, find_in_batch
from .profiles import Profile

# Fixed values of the public profile: the options in order of priority.
OPTIONS = ("CleanGraphics", "CleanStructuredContent", "CleanDescriptors", "RetainLongitudinalTemporal", "RetainPatientCharacteristics", "RetainDeviceIdentity", "RetainUIDs", "RetainSafePrivate", "RetainInstitutionIdentity")
#: Replacement values by representation.
DUMMIES = {"PN": "Anonymized", **dict.fromkeys(("LO", "SH", "LT", "ST", "UT", "UC", "AE", "CS"), "ANONYMIZED"), "UR": "anonymized", "DA": "10000101", "DT": "10000101000000", "TM": "000000", "AS": "000Y", "DS": "0", "IS": "0"}
METHOD = "Radiolith Basic Application Level Confidentiality Profile"
AUDIT_CAP = 64
INSTANCE_UID = "media_storage_sop_instance_uid"


class DeidentifyError(ValueError):
    """Options that cannot be."""


def check_options(retain: Sequence[str]) -> tuple[str, ...]:
    """The options in order of priority; an unknown one raises."""
    if unknown := set(retain) - set(OPTIONS):
        raise DeidentifyError(f"unknown options: {len(unknown)}")
    return tuple(o for o in OPTIONS if o in retain)


def effective_code(basic: Column, options: Column, active: Sequence[str]) -> Column:
    """The first active option's override in order of priority, else the basic code."""
    return F.coalesce(*[F.element_at(options, F.lit(o)) for o in active], basic) if active else basic


def resolve_code(code: Column) -> Column:
    """The leftmost branch of a conditional code, without its star."""
    return F.replace(F.get(F.split(code, "/"), 0), F.lit("*"), F.lit(""))


def dummy(vr: Column) -> Column:
    """The replacement bytes of a representation, of even length; nothing for others."""
    value = F.lit("")
    for k, v in DUMMIES.items():
        value = F.when(vr == k, F.lit(v)).otherwise(value)
    return V.pad_even(F.encode(value, "ISO-8859-1"), vr)


def _embedded_udf(actionable: set[str], groups: set[str]):
    @F.pandas_udf(BooleanType())
    def found(raw: pd.Series, vr: pd.Series, encoding: pd.Series) -> pd.Series:
        act = lambda tag: tag[3] in "13579BDF" or tag in actionable or tag[:4] in groups
        return pd.Series(find_in_batch([None if r is None else bytes(r) for r in raw], vr.tolist(), encoding.tolist(), act))

    return found


#: Columns that are passed on, all rewritten by what was done; others could hold what was removed.
COLUMNS = ("object_id", "encoding", "path", "ord", "tag", "vr", "length", "little_endian", "charset", "private_creator", "cp246_promoted", "item_count", "full_span", "raw", "value", "byte_offset", "leave")


def _retained_private(rows: DataFrame, elements: DataFrame, profile: Profile) -> DataFrame:
    """Adds ``private_creator``, ``declared`` and ``_named``: whether the profile names a private element within settled bounds."""
    spark, usable = elements.sparkSession, F.lit(True)
    rows = rows.withColumn("_text", V.ascii_text(F.col("raw")))
    if {"length", "byte_offset"} <= set(elements.columns):
        rows = settled(poisoned(rows.withColumn("overruns", overruns(rows, "encoding"))))
        usable = F.col("settled") & ~F.col("poisoned")
        rows = rows.withColumn("_text", F.when(usable, F.col("_text")).otherwise(F.lit("")))  # a creator there reserves nothing
    rows = resolve_creators(rows.withColumn("_usable", usable), ordered=False, value="_text")
    p = F.broadcast(profile.private_table(spark).select(F.col("creator").alias("_c"), F.col("key").alias("_key"), F.col("vr").alias("declared")))
    rows = rows.join(p, (F.col("private_creator") == F.col("_c")) & (T.canonical_private_key(F.col("tag")) == F.col("_key")), "left")
    names = list(profile.private)
    slot_kept = T.is_private_creator_slot(F.col("tag")) & F.trim(V.ascii_text(F.col("raw"))).isin(*names) if names else F.lit(False)
    return rows.withColumn("_named", F.col("_usable") & (F.col("_key").isNotNull() | slot_kept))


def deidentify(elements: DataFrame, retain: Sequence[str] = (), uid_root: str = U.DEFAULT_ROOT, profile: Profile | None = None, method: str | None = None, encoding: str = "explicit-le", actions: DataFrame | None = None, scan_embedded: bool = True, uid_map: DataFrame | None = None, private_values: str = "removed") -> tuple[DataFrame, DataFrame]:
    """``(elements, audit)`` of ``elements(object_id, path, ord, tag, vr, raw, item_count)``; ``ord`` tells the rows of an object apart.

    ``audit(object_id, path, ord, tag, vr, code, applied)`` has a row for every element with a rule, every private one and every removed one;
    ``applied`` is kept, removed, emptied, cleaned, dummied, remapped, or the reason why a value that would be
    kept was emptied or taken out: undefined-vr, embedded, unauditable or unenumerable. Descendants of a sequence that goes are removed with it.
    Values are scanned in the encoding that a column ``encoding`` names for each, else in the one given. Where there are columns
    ``length`` and ``byte_offset``, private elements beyond a disputed boundary, or in items below one, are not retained.
    Of private elements that RetainSafePrivate and ``profile`` name stay creators, empty values, and sequences, whose items go by their
    own rules; other values cannot be looked into and are removed, unless ``private_values`` is "kept".
    Of the columns those in ``COLUMNS`` are passed on: ``value``, ``length`` and ``raw`` say what is left, places in the original file are null, and a sequence that stays
    has its items as rows and no bytes of its own (see ``nesting.rebuild``). UIDs are replaced by ``uid_map(original, replacement)``
    where it has them.
    """
    if private_values not in ("removed", "kept"):
        raise DeidentifyError("private values are removed or kept")
    spark, active = elements.sparkSession, check_options(retain)
    table = actions if actions is not None else D.actions(spark)
    resolved = table.select("tag", resolve_code(effective_code(F.col("basic"), F.col("options"), active)).alias("code"))
    masked = D.masked_groups(spark).select(F.col("grp"), resolve_code(effective_code(F.col("basic"), F.col("options"), active)).alias("gcode"))
    rules, masks = resolved.collect(), masked.collect()  # rows of the registry, whatever the data
    retaining = "RetainSafePrivate" in active and profile is not None
    columns = [c for c in elements.columns if c in COLUMNS]
    rows = elements.select(*columns)
    if "encoding" not in columns:
        rows = rows.withColumn("encoding", F.lit(encoding))
    if retaining:
        rows = _retained_private(nesting.intervals(rows), elements, profile)
    else:
        rows = rows.withColumn("declared", F.lit(None).cast("string")).withColumn("_named", F.lit(False))
    r = F.broadcast(resolved.select(F.col("tag").alias("_t"), F.col("code").alias("_code")))
    g = F.broadcast(masked)
    rows = rows.join(r, F.col("tag") == F.col("_t"), "left").join(g, F.substring("tag", 1, 4) == F.col("grp"), "left")
    rows = rows.withColumn("code", F.coalesce("_code", "gcode"))
    code = F.col("code")
    empty = F.length("raw") == 0
    vr, sq = F.col("vr"), F.col("vr") == "SQ"
    undefined = ~V.is_recognized_vr(vr)
    unauditable = sq & F.col("item_count").isNull()
    embedded = F.lit(False)
    if scan_embedded:
        act = {x["tag"] for x in rules if x["code"] != "K"}
        found = _embedded_udf(act, {x["grp"] for x in masks if x["gcode"] != "K"})
        # the shortest run is one header, and a run holds a control byte
        wanted = vr.isin(*SCANNABLE) & (F.length("raw") >= 8) & V.ascii_text(F.col("raw")).rlike(r"[\x00-\x1F\x7F]")
        embedded = F.when(wanted, found(F.when(wanted, F.col("raw")), vr, F.col("encoding"))).otherwise(F.lit(False))
    # the UIDs that a rule replaces are known before the scan: both go through Python in one pass
    derived = {} if uid_map is not None else {"_derived": U.remap_values(F.when((code == "U") & ~sq, V.ascii_text(F.col("raw"))), uid_root)}
    rows = rows.withColumns({"_embedded": F.coalesce(embedded, F.lit(False)), **derived})
    keep = F.when(undefined, "undefined-vr").when(F.col("_embedded"), "embedded").otherwise("kept")
    private = T.is_private_tag(F.col("tag"))
    value_kept = keep if private_values == "kept" else F.when(keep == "kept", "unenumerable").otherwise(keep)
    kept_private = F.when(unauditable, "unauditable").when(sq, "kept").when(~undefined & ~empty & (F.col("declared") == "SQ"), "unauditable").when(T.is_private_creator_slot(F.col("tag")) | empty, keep).otherwise(value_kept)
    applied = (
        F.when(private & ~F.col("_named"), "removed").when(private, kept_private)
        .when(code.isNull() & unauditable, "unauditable").when(code.isNull() & sq, "kept").when(code.isNull(), keep)
        .when(code == "X", "removed")
        .when(sq & code.isin("Z", "D"), "emptied").when(unauditable, "unauditable").when(sq & (code == "C"), "cleaned").when(sq, "kept")
        .when(code == "K", keep).when(code == "Z", "emptied").when(code == "C", "cleaned").when(code == "D", "dummied").when(code == "U", "remapped").otherwise("removed")
    )
    rows = rows.withColumn("applied", applied)
    if retaining:
        lost = nesting.inside(sq & ~F.col("applied").isin("kept", "cleaned"))
    else:
        going = sorted({x["tag"] for x in rules if x["code"] in ("X", "Z", "D")})
        groups_going = sorted({x["grp"] for x in masks if x["gcode"] in ("X", "Z", "D")})
        above = F.regexp_extract_all("path", F.lit(r"([0-9A-F]{8})\["), 1)
        lost = F.exists(above, lambda t: t.isin(*going) | F.substring(t, 1, 4).isin(*groups_going) | F.substring(t, 4, 1).isin(*"13579BDF"))
    rows = rows.withColumn("_lost", lost).withColumn("applied", F.when(F.col("_lost"), "removed").otherwise(F.col("applied")))
    audit = rows.where(code.isNotNull() | private | (F.col("applied") != "kept")).select("object_id", "path", "ord", "tag", "vr", "code", "applied")
    if uid_map is not None:
        text = rows.where("applied = 'remapped'").select("object_id", "ord", V.ascii_text(F.col("raw")).alias("_uids"))
        given = U.mapped_values(text, ("object_id", "ord"), "_uids", uid_map, uid_root).withColumnsRenamed({"object_id": "_uo", "ord": "_un"})
        rows = rows.join(given, (F.col("object_id") == F.col("_uo")) & (F.col("ord") == F.col("_un")), "left")
        new_uids = V.pad_even(F.encode("replaced", "ISO-8859-1"), F.lit("UI"))
    else:
        new_uids = V.pad_even(F.encode("_derived", "ISO-8859-1"), F.lit("UI"))
    return _with_method(_rewritten(rows, new_uids, "value" in columns), columns, dict(elements.dtypes), method or "\\".join((METHOD, *active))), audit


def _rewritten(rows: DataFrame, new_uids: Column, values: bool) -> DataFrame:
    """The rows with every column saying what is left of the element; ``_prior`` keeps the old bytes of a method until it is joined."""
    sq, done = F.col("vr") == "SQ", F.col("applied")
    as_it_was = (done == "kept") & ~sq
    rows = rows.withColumn("_prior", F.when((F.col("path") == "") & (F.col("tag") == "00120063"), F.col("raw")))
    if values:
        rows = rows.withColumn("_before", F.when(as_it_was, F.col("value")))
    rows = rows.withColumn("raw", F.when(as_it_was, F.col("raw")).when(done == "dummied", dummy(F.col("vr"))).when(done == "remapped", new_uids).otherwise(F.unhex(F.lit(""))))
    rows = rows.withColumn("item_count", F.when(sq & done.isin("emptied", "unauditable"), 0).otherwise(F.col("item_count")))
    rows = rows.withColumn("length", F.length("raw").cast("long"))
    if values:
        rows = rows.withColumn("value", F.when(as_it_was, F.col("_before")).otherwise(V.strip_pad(V.ascii_text(F.col("raw")))))
    for name, kind in (("byte_offset", "long"), ("leave", "int")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.withColumn("full_span", F.when(as_it_was, F.col("full_span")).otherwise(False) if "full_span" in rows.columns else F.lit(False))


def _with_method(rows: DataFrame, columns: Sequence[str], types: dict[str, str], method: str) -> DataFrame:
    """The rows that stay, with ``(0012,0062)`` and the method's values in ``(0012,0063)`` added or replaced; new elements come last.

    A prior method with control characters is not kept, as it may hide elements.
    """
    whole = Window.partitionBy("object_id")
    root, tag, text = F.col("path") == "", F.col("tag"), V.ascii_text(F.col("_prior"))
    rows = rows.withColumn("_last", F.max("ord").over(whole))
    for low in ("62", "63"):
        rows = rows.withColumn(f"_o{low}", F.max(F.when(root & (tag == f"001200{low}"), F.col("ord"))).over(whole))
    plain = root & (tag == "00120063") & (F.col("vr") == "LO") & ~V.strip_pad(text).rlike(r"[\x00-\x1A\x1C-\x1F\x7F]")
    rows = rows.withColumn("_prior", F.max(F.when(plain, text)).over(whole))
    prior = F.coalesce("_prior", F.lit(""))
    rows = rows.withColumn("_method", F.when(F.col("ord") == F.col("_last"), F.when(prior == "", F.lit(method)).otherwise(added_method(prior, method))))
    stays = ~F.col("applied").isin("removed", "unenumerable") & ~(root & tag.isin("00120062", "00120063"))
    # copies of a row are told by numbers, so that rows are not packed into arrays and taken apart again
    rows = rows.withColumn("_stays", stays).withColumn("_copy", F.explode(F.when(F.col("ord") == F.col("_last"), F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(F.lit(0)))))
    rows = rows.where((F.col("_copy") > 0) | F.col("_stays"))
    first, low = F.col("_copy") == 1, F.when(F.col("_copy") == 1, "00120062").otherwise("00120063")
    vr, value = F.when(first, "CS").otherwise("LO"), F.when(first, "YES").otherwise(F.col("_method"))
    raw = F.when(first, V.pad_even(F.encode(F.lit("YES"), "ISO-8859-1"), F.lit("CS"))).otherwise(V.pad_even(F.encode("_method", "ISO-8859-1"), F.lit("LO")))
    at = F.when(first, F.coalesce("_o62", F.col("_last") + 1)).otherwise(F.coalesce("_o63", F.col("_last") + 2))
    added = {"object_id": F.col("object_id"), "path": F.lit(""), "encoding": F.col("encoding"), "ord": at, "tag": low, "vr": vr, "raw": raw, "value": value, "length": F.length(raw), "full_span": F.lit(False)}
    return rows.select(*[F.when(F.col("_copy") == 0, F.col(c).cast(types[c])).otherwise((added[c] if c in added else F.lit(None)).cast(types[c])).alias(c) for c in columns])


@dataclass(frozen=True)
class Deidentified:
    """What one call gives: files and elements to write, the audit, and the map of replaced UIDs."""

    files: DataFrame
    elements: DataFrame
    audit: DataFrame
    uids: DataFrame


def deidentify_files(files: DataFrame, elements: DataFrame, retain: Sequence[str] = (), uid_root: str = U.DEFAULT_ROOT, uid_map: DataFrame | None = None, **options) -> Deidentified:
    """Files with their elements, the instance UID of the file meta replaced like that of the data set.

    ``files(object_id, meta, residue)`` keep those columns; a file's residue, elements of the file meta group that no field holds, is dropped, as no rule covers it.
    ``uids(original, replacement)`` has the given map and what was derived in this run: written after each run and given
    to the next, it keeps every replacement. Other options are those of ``deidentify``.
    """
    active, spark = check_options(retain), files.sparkSession
    known = uid_map if uid_map is not None else spark.createDataFrame([], "original string, replacement string")
    out, audit = deidentify(elements, retain, uid_root, uid_map=uid_map, **options)
    named = elements.join(audit.where("applied = 'remapped'").select(F.col("object_id").alias("_o"), F.col("ord").alias("_n")), (F.col("object_id") == F.col("_o")) & (F.col("ord") == F.col("_n")), "left_semi")
    found = U.single_values(named.select("object_id", "ord", V.ascii_text(F.col("raw")).alias("u")), ("object_id", "ord"), "u").select("uid")
    kept = files.select("object_id", "meta", F.array().cast("array<struct<tag:string,vr:string,value:binary>>").alias("residue"))
    if "RetainUIDs" not in active:
        own = F.element_at("meta", INSTANCE_UID)
        found = found.union(files.where(own.isNotNull()).select(own))
    uids = U.extend_map(known, found, "uid", uid_root)
    if "RetainUIDs" not in active and uid_map is not None:
        given = U.mapped_values(files.select("object_id", F.element_at("meta", INSTANCE_UID).alias("u")), ("object_id",), "u", uid_map, uid_root).withColumnRenamed("object_id", "_o")
        kept = kept.join(given, F.col("object_id") == F.col("_o"), "left")
        kept = kept.select("object_id", _with_instance_uid("meta", F.col("replaced")).alias("meta"), "residue")
    else:
        kept = remap_file_meta(kept, "meta", retain, uid_root)
    return Deidentified(kept, out, audit, uids)


def report(elements: DataFrame, audit: DataFrame, attributes: DataFrame, method: str, cap: int = AUDIT_CAP, retain: Sequence[str] = (), uids: DataFrame | None = None) -> dict[str, DataFrame]:
    """The de-identification report as nine tables: what happened to what, by kind.

    ``attributes`` has a row for each audited element with its keyword and the prefix of its repeating group; ``removed_private``,
    ``embedded``, ``unauditable`` and ``undefined_vr`` hold those of one outcome, at most ``cap`` an object, with ``withheld``, how many
    more there are; ``unenumerable`` has all retained private values that were taken out. ``warnings(object_id, code)`` holds what calls for a
    look; ``uid_map`` is the map of replaced UIDs, and ``retained`` the options in order of priority.
    """
    names = F.broadcast(attributes.select(F.col("tag").alias("_t"), F.col("keyword")))
    pair = F.substring("tag", 1, 2)
    repeating = F.when(pair.isin(*D.REPEATING) & F.substring("tag", 1, 4).isin(*[g for p in D.REPEATING for g in D.repeating_groups(p)]), pair)
    full = audit.join(names, F.col("tag") == F.col("_t"), "left").drop("_t").withColumn("repeating_group", repeating)

    def some(condition: Column) -> DataFrame:
        whole = Window.partitionBy("object_id")
        rows = full.where(condition).withColumn("_n", F.row_number().over(whole.orderBy("ord"))).withColumn("withheld", F.greatest(F.count("*").over(whole) - cap, F.lit(0)))
        return rows.where(F.col("_n") <= cap).drop("_n")

    coded = lambda rows, code: rows.select("object_id", F.lit(code).alias("code")).distinct()
    root, private = F.col("path") == "", T.is_private_tag(F.col("tag"))
    prior = elements.where(root & (F.col("tag") == "00120063"))
    text = V.ascii_text(F.col("raw"))
    fits = F.length(F.concat(text, F.lit("\\" + method))) <= 0xFFFE
    some_text = (F.col("vr") == "LO") & (V.strip_pad(text) != "")
    whole = elements if any(len(x) > 64 for x in method.split("\\")) else prior.where(over_length(text))
    warnings = [
        coded(burned_in(elements.withColumn("_text", text), "_text"), "BURNED_IN_ANNOTATION_NOT_REMOVED"), coded(prior.where(some_text & fits), "DEIDENT_METHOD_PRIOR_RETAINED"),
        coded(prior.where(some_text & ~fits), "DEIDENT_METHOD_NOT_ADDED"), coded(prior.where(F.col("vr") != "LO"), "DEIDENT_METHOD_NOT_LO"), coded(whole, "DEIDENT_METHOD_VALUE_OVER_LENGTH"),
        coded(audit.where("applied = 'embedded'"), "DEIDENT_EMBEDDED_ATTRIBUTE_REMOVED"), coded(audit.where("applied = 'undefined-vr'"), "DEIDENT_UNDEFINED_VR_NOT_AUDITABLE"),
        coded(audit.where((F.col("applied") == "unauditable") & private & (F.col("vr") != "SQ")), "DEIDENT_PRIVATE_CARRIER_NOT_AUDITABLE"),
        coded(audit.where((F.col("applied") == "unauditable") & ~(private & (F.col("vr") != "SQ"))), "DEIDENT_SEQUENCE_NOT_AUDITABLE"),
    ]
    spark = elements.sparkSession
    return {
        "attributes": full, "removed_private": some(private & (F.col("applied") == "removed")), "embedded": some(F.col("applied") == "embedded"), "unauditable": some(F.col("applied") == "unauditable"),
        "unenumerable": full.where("applied = 'unenumerable'"), "undefined_vr": some(F.col("applied") == "undefined-vr"), "warnings": functools.reduce(DataFrame.union, warnings),
        "uid_map": uids if uids is not None else spark.createDataFrame([], "original string, replacement string"),
        "retained": spark.createDataFrame([(i, o) for i, o in enumerate(check_options(retain))], "priority int, option string"),
    }


def added_method(prior: Column, method: str) -> Column:
    """The prior values, then those of ``method`` that are not among them (padding at the end does not count); the method alone if all would not fit."""
    old = F.filter(F.split(prior, r"\\"), lambda x: V.strip_pad(x) != "")
    seen = F.transform(old, V.strip_pad)
    new = F.filter(F.split(F.lit(method), r"\\"), lambda x: ~F.array_contains(seen, x))
    joined = F.array_join(F.concat(old, new), "\\")
    return F.when(F.length(joined) > 0xFFFE, F.lit(method)).otherwise(joined)


def over_length(value: Column) -> Column:
    """Whether a value of a list exceeds the 64 bytes of LO."""
    return F.exists(F.split(value, r"\\"), lambda x: F.octet_length(x) > 64)


def burned_in(elements: DataFrame, value: str = "value") -> DataFrame:
    """Objects with pixel data that are not marked as free of burned-in identity."""
    pixel = F.bool_or((F.col("tag") == "7FE00010") & (F.col("path") == "")).alias("pixel")
    mark = F.max(F.when((F.col("tag") == "00280301") & (F.col("path") == ""), F.upper(F.trim(F.col(value))))).alias("mark")
    return elements.groupBy("object_id").agg(pixel, mark).where("pixel and coalesce(mark, '') <> 'NO'").select("object_id")


def remap_file_meta(objects: DataFrame, column: str, retain: Sequence[str] = (), uid_root: str = U.DEFAULT_ROOT) -> DataFrame:
    """File meta with the instance UID replaced unless UIDs are retained; ``column`` is a string, or the map ``meta`` of files."""
    if "RetainUIDs" in check_options(retain):
        return objects
    if not dict(objects.dtypes)[column].startswith("map"):
        return objects.withColumn(column, U.remap_values(F.col(column), uid_root))
    return objects.withColumn(column, _with_instance_uid(column, U.remap_values(F.element_at(column, INSTANCE_UID), uid_root)))


def _with_instance_uid(column: str, new: Column) -> Column:
    own = F.map_from_arrays(F.array(F.lit(INSTANCE_UID)), F.array(new))
    rest = F.map_filter(column, lambda k, _: k != INSTANCE_UID)
    return F.when(F.map_contains_key(column, INSTANCE_UID), F.map_concat(rest, own)).otherwise(F.col(column))
