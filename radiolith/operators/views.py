"""Typed patient, study, series and image views as conditional aggregates over the element table.

Only elements of the wanted tags reach the aggregate (the filter goes down to the scan), and one pass builds a
whole view. A missing, empty or malformed value is null, and nothing is ever filled in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolith.functions import values as V

from .dictionary import CODING_SCHEMES
from .elements import items_of, tagged

# Fixed values of the data model: field, tag and reader (S string, N number, A numbers, PN, DA, TM).
PATIENT = {"id": ("00100020", "S"), "issuer_of_id": ("00100021", "S"), "name": ("00100010", "PN"), "birth_date": ("00100030", "DA"), "sex": ("00100040", "S")}
STUDY = {"instance_uid": ("0020000D", "S"), "id": ("00200010", "S"), "accession_number": ("00080050", "S"), "date": ("00080020", "DA"), "time": ("00080030", "TM"), "description": ("00081030", "S")}
SERIES = {"instance_uid": ("0020000E", "S"), "number": ("00200011", "N"), "modality": ("00080060", "S"), "description": ("0008103E", "S"), "frame_of_reference_uid": ("00200052", "S")}
IMAGE = {
    "sop_instance_uid": ("00080018", "S"), "rows": ("00280010", "N"), "columns": ("00280011", "N"), "samples_per_pixel": ("00280002", "N"), "photometric_interpretation": ("00280004", "S"), "planar_configuration": ("00280006", "N"),
    "bits_allocated": ("00280100", "N"), "bits_stored": ("00280101", "N"), "high_bit": ("00280102", "N"), "pixel_representation": ("00280103", "N"), "rescale_slope": ("00281053", "N"), "rescale_intercept": ("00281052", "N"), "rescale_type": ("00281054", "S"),
    "slice_thickness": ("00180050", "N"), "spacing_between_slices": ("00180088", "N"), "frame_of_reference_uid": ("00200052", "S"), "number_of_frames": ("00280008", "N"), "units": ("00541001", "S"),
    "window_center": ("00281050", "A"), "window_width": ("00281051", "A"), "pixel_spacing": ("00280030", "A"), "imager_pixel_spacing": ("00181164", "A"), "nominal_scanned_pixel_spacing": ("00182010", "A"), "image_position_patient": ("00200032", "A"), "image_orientation_patient": ("00200037", "A"),
}
PER_FRAME, SHARED, REQUIRED_MACROS = "52009230", "52009229", ("00289110", "00209113", "00209116")


def first_string(value: Column) -> Column:
    """The first value of a list, or null if it is empty."""
    return F.nullif(V.first_value(value), F.lit(""))


def first_number(value: Column) -> Column:
    return V.decimal_string(V.first_token(value))


def number_array(value: Column) -> Column:
    """All numbers of a list; a malformed one is null within the array."""
    return F.when(V.strip_pad(value) != "", F.transform(V.tokens(value), V.decimal_string))


def person_name(value: Column) -> Column:
    return F.when(V.strip_pad(value) != "", V.parse_person_name(V.first_value(value)))


def date(value: Column) -> Column:
    return F.when(V.strip_pad(value) != "", V.parse_date(V.first_token(value)))


def time(value: Column) -> Column:
    return F.when(V.strip_pad(value) != "", V.parse_time(V.first_token(value)))


READERS = {"S": first_string, "N": first_number, "A": number_array, "PN": person_name, "DA": date, "TM": time}


def view(elements: DataFrame, fields: dict[str, tuple[str, str]], keys: tuple[str, ...] = ("object_id",), value: str = "value") -> DataFrame:
    """One row for each ``keys`` with the decoded fields. Root elements; filter to items first for other levels."""
    wanted = elements.where(F.col("tag").isin(*{t for t, _ in fields.values()}))
    wide = wanted.groupBy(*keys).agg(*[F.max(F.when(F.col("tag") == t, F.col(value))).alias(t) for t in sorted({t for t, _ in fields.values()})])
    return wide.select(*keys, *[READERS[r](F.col(t)).alias(n) for n, (t, r) in fields.items()])


def view_of_files(files: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """:func:`view` of parsed files, which are a row each with all their elements: nothing is exploded, grouped or shuffled. Root elements.

    ``object_id`` is one file's. A file without an element of the wanted tags, or with an error, has no row, as in :func:`view`.
    """
    tags = sorted({t for t, _ in fields.values()})
    some = F.exists("elements", lambda e: e["tag"].isin(*tags) & (e["path"] == ""))  # what decodes nothing, as a filter is computed anew
    held = files.where(some).select("object_id", F.map_from_entries(tagged(tags)).alias("_held"))
    wide = held.select("object_id", *[F.element_at("_held", t).alias(t) for t in tags])
    return wide.select("object_id", *[READERS[r](F.col(t)).alias(n) for n, (t, r) in fields.items()])


def _root(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("path") == "")


OTHER_IDS, ISSUER_QUALIFIERS = "00101002", "00100024"


def patient_view(elements: DataFrame) -> DataFrame:
    """The patient fields, ``other_ids`` and ``issuer_qualifiers``: an entry for each item of their sequences, in one pass.

    An entry of ``other_ids`` has ``id, issuer, type_code``; one of ``issuer_qualifiers`` maps tags to first values.
    """
    root = F.col("path") == ""
    inner = F.col("path").rlike(rf"^({OTHER_IDS}|{ISSUER_QUALIFIERS})\[[0-9]+\]\z")
    tags = sorted({t for t, _ in PATIENT.values()})
    rows = elements.where((root & F.col("tag").isin(*tags, OTHER_IDS, ISSUER_QUALIFIERS)) | inner)
    cell = F.struct(F.substring("path", 1, 8).alias("of"), F.regexp_extract("path", r"\[([0-9]+)\]", 1).try_cast("int").alias("item"), F.col("tag").alias("tag"), first_string(F.col("value")).alias("value"))
    count = lambda t: F.max(F.when(root & (F.col("tag") == t), F.col("item_count")))
    wide = rows.groupBy("object_id").agg(*[F.max(F.when(root & (F.col("tag") == t), F.col("value"))).alias(t) for t in tags], F.collect_list(F.when(inner, cell)).alias("cells"), count(OTHER_IDS).alias("n_other"), count(ISSUER_QUALIFIERS).alias("n_issuer"))

    def items(n: str, of: str, entry) -> Column:
        own = lambda i: F.filter("cells", lambda c: (c["of"] == of) & (c["item"] == i))
        found = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: entry(own(i)))
        return F.coalesce(F.when(F.col(n) > 0, found), F.array().cast("array<struct<id:string,issuer:string,type_code:string>>" if of == OTHER_IDS else "array<map<string,string>>"))

    one = lambda cells, tag: F.get(F.filter(cells, lambda c: c["tag"] == tag), 0)["value"]
    other = items("n_other", OTHER_IDS, lambda c: F.struct(one(c, "00100020").alias("id"), one(c, "00100021").alias("issuer"), one(c, "00100022").alias("type_code")))
    issuer = items("n_issuer", ISSUER_QUALIFIERS, lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["tag"], x["value"]))))
    return wide.select("object_id", *[READERS[r](F.col(t)).alias(n) for n, (t, r) in PATIENT.items()], other.alias("other_ids"), issuer.alias("issuer_qualifiers"))


def study_view(elements: DataFrame) -> DataFrame:
    return view(_root(elements), STUDY)


def series_view(elements: DataFrame) -> DataFrame:
    return view(_root(elements), SERIES)


def image_view(elements: DataFrame) -> DataFrame:
    """The image fields and ``signed``: 0 is false, 1 true, anything else absent."""
    return _signed(view(_root(elements), IMAGE))


def image_view_of_files(files: DataFrame) -> DataFrame:
    """:func:`image_view` of parsed files; see :func:`view_of_files`."""
    return _signed(view_of_files(files, IMAGE))


def _signed(out: DataFrame) -> DataFrame:
    p = F.col("pixel_representation")
    return out.withColumn("signed", F.when(p == 0, False).when(p == 1, True))


def other_patient_ids(elements: DataFrame) -> DataFrame:
    """``(object_id, item, id, issuer, type_code)`` of the items of the other-ids sequence, in item order."""
    return view(items_of(elements, "00101002"), {"id": ("00100020", "S"), "issuer": ("00100021", "S"), "type_code": ("00100022", "S")}, ("object_id", "item"))


def real_world_value_maps(elements: DataFrame) -> DataFrame:
    """``(object_id, item, slope, intercept, units)`` of the mapping sequence."""
    maps = view(items_of(elements, "00409096"), {"slope": ("00409225", "N"), "intercept": ("00409224", "N")}, ("object_id", "item"))
    units = elements.where(F.col("path").rlike(r"^00409096\[[0-9]+\]/004008EA\[0\]\z") & (F.col("tag") == "00080100"))
    units = units.select(F.col("object_id").alias("_o"), F.regexp_extract("path", r"^00409096\[([0-9]+)\]", 1).try_cast("int").alias("_i"), first_string(F.col("value")).alias("units"))
    return maps.join(units, (F.col("object_id") == F.col("_o")) & (F.col("item") == F.col("_i")), "left").drop("_o", "_i")


def coding_scheme_oid(designator: Column) -> Column:
    """The UID of a coding scheme, for the four that have one here; else null."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in CODING_SCHEMES.items():
        out = out.when(designator == k, v)
    return out


def coded_concepts(elements: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(value, designator, meaning, scheme_uid)`` for each of ``keys``."""
    out = view(elements, {"value_code": ("00080100", "S"), "designator": ("00080102", "S"), "meaning": ("00080104", "S")}, keys)
    return out.withColumn("scheme_uid", coding_scheme_oid(F.col("designator")))


def has_functional_groups(elements: DataFrame) -> DataFrame:
    return elements.groupBy("object_id").agg(F.bool_or(F.col("tag").isin(PER_FRAME, SHARED) & (F.col("path") == "")).alias("enhanced"))


def frame_macros(frames: DataFrame, per_frame: DataFrame, shared: DataFrame) -> DataFrame:
    """Each frame's macro from its own item, else the shared one, taken whole.

    ``frames(object_id, frame)``, ``per_frame(object_id, frame, macro)``, ``shared(object_id, macro)``, macros being structs.
    """
    p = per_frame.select(F.col("object_id").alias("_o"), F.col("frame").alias("_f"), F.col("macro").alias("_p"))
    s = shared.select(F.col("object_id").alias("_so"), F.col("macro").alias("_s"))
    out = frames.join(p, (F.col("object_id") == F.col("_o")) & (F.col("frame") == F.col("_f")), "left").join(s, F.col("object_id") == F.col("_so"), "left")
    return out.select(*frames.columns, F.coalesce("_p", "_s").alias("macro"))


def frame_error(index: Column, frames: Column, macros: Column) -> Column:
    """The code of what is wrong with a request for a frame, or null: its index, else a required macro that is not there."""
    missing = F.exists(F.array(*[F.lit(m) for m in REQUIRED_MACROS]), lambda m: ~F.array_contains(macros, m))
    return F.when((index < 0) | (index >= F.coalesce(frames, F.lit(1))), "FRAME_INDEX_OUT_OF_RANGE").when(missing, "MISSING_REQUIRED_FUNCTIONAL_GROUP")


# Fixed values of the data model: macro, its tag, and fields as above.
MACROS = {
    "pixel_measures": ("00289110", {"pixel_spacing": ("00280030", "A"), "slice_thickness": ("00180050", "N"), "spacing_between_slices": ("00180088", "N")}),
    "plane_position": ("00209113", {"image_position_patient": ("00200032", "A")}),
    "plane_orientation": ("00209116", {"image_orientation_patient": ("00200037", "A")}),
    "pixel_value_transformation": ("00289145", {"rescale_slope": ("00281053", "N"), "rescale_intercept": ("00281052", "N"), "rescale_type": ("00281054", "S")}),
    "frame_voi_lut": ("00289132", {"window_center": ("00281050", "A"), "window_width": ("00281051", "A")}),
}


def frames(elements: DataFrame) -> DataFrame:
    """``(object_id, frame, error, ...)``: every frame of the objects with functional groups, with a struct for each macro.

    A macro is taken whole from the frame's own item, else from the shared one; ``error`` is the code of a required one that neither has.
    """
    scope = rf"^({PER_FRAME}|{SHARED})\[([0-9]+)\]"
    rows = elements.where(F.col("path").rlike(scope))
    rows = rows.withColumn("_of", F.regexp_extract("path", scope, 1)).withColumn("frame", F.regexp_extract("path", scope, 2).try_cast("int"))
    rows = rows.withColumn("_in", F.regexp_extract("path", scope + r"/([0-9A-F]{8})\[0\]\z", 3)).withColumn("_top", F.col("path").rlike(scope + r"\z"))
    aggregates = []
    for name, (macro, fields) in MACROS.items():
        aggregates.append(F.bool_or(F.col("_top") & (F.col("tag") == macro) & (F.col("item_count") > 0)).alias(f"has_{name}"))
        aggregates += [F.max(F.when((F.col("_in") == macro) & (F.col("tag") == t), F.col("value"))).alias(f"{name}_{field}") for field, (t, _) in fields.items()]
    wide = rows.groupBy("object_id", "_of", "frame").agg(*aggregates)
    macros = [F.when(F.col(f"has_{name}"), F.struct(*[READERS[r](F.col(f"{name}_{field}")).alias(field) for field, (_, r) in fields.items()])).alias(name) for name, (_, fields) in MACROS.items()]
    wide = wide.select("object_id", "_of", "frame", *macros)
    own = wide.where(F.col("_of") == PER_FRAME).select(F.col("object_id").alias("_o"), F.col("frame").alias("_f"), *[F.col(n).alias(f"_own_{n}") for n in MACROS])
    shared = wide.where((F.col("_of") == SHARED) & (F.col("frame") == 0)).select(F.col("object_id").alias("_so"), *[F.col(n).alias(f"_shared_{n}") for n in MACROS])
    root = F.col("path") == ""
    objects = elements.where(root & F.col("tag").isin(PER_FRAME, SHARED, "00280008")).groupBy("object_id").agg(
        F.bool_or(F.col("tag").isin(PER_FRAME, SHARED)).alias("enhanced"), F.max(F.when(F.col("tag") == "00280008", F.col("value"))).alias("n"))
    count = F.coalesce(first_number(F.col("n")).cast("int"), F.lit(1))
    every = objects.where(F.col("enhanced") & (count > 0)).select("object_id", F.explode(F.sequence(F.lit(0), count - 1)).alias("frame"))
    met = every.join(own, (F.col("object_id") == F.col("_o")) & (F.col("frame") == F.col("_f")), "left").join(shared, F.col("object_id") == F.col("_so"), "left")
    met = met.select("object_id", "frame", *[F.coalesce(f"_own_{n}", f"_shared_{n}").alias(n) for n in MACROS])
    missing = F.col("pixel_measures").isNull() | F.col("plane_position").isNull() | F.col("plane_orientation").isNull()
    return met.select("object_id", "frame", F.when(missing, "MISSING_REQUIRED_FUNCTIONAL_GROUP").alias("error"), *MACROS)


def index_studies(elements: DataFrame) -> DataFrame:
    """The flagship: one row an object with what a study index holds."""
    fields = {"patient_id": ("00100020", "S"), "issuer": ("00100021", "S"), "patient_name": ("00100010", "PN"), "study_uid": ("0020000D", "S"), "accession": ("00080050", "S"), "study_date": ("00080020", "DA"), "study_time": ("00080030", "TM"), "description": ("00081030", "S")}
    out = view(_root(elements), fields)
    name, d, t = F.col("patient_name.alphabetic"), F.col("study_date"), F.col("study_time")
    return out.select("object_id", "patient_id", "issuer", name["family"].alias("family"), name["given"].alias("given"), "study_uid", "accession", F.col("study_date.year").alias("year"), F.col("study_date.month").alias("month"), F.col("study_date.day").alias("day"), F.col("study_time.hours").alias("hours"), "description", routing_key(F.col("issuer"), F.col("patient_id")).alias("routing_key"), started(d, t).alias("started"))


def routing_key(issuer: Column, patient_id: Column) -> Column:
    """Issuer, bar, id; an absent part is empty."""
    return F.concat(F.coalesce(issuer, F.lit("")), F.lit("|"), F.coalesce(patient_id, F.lit("")))


def started(d: Column, t: Column) -> Column:
    """ISO start of a study from its date and time structs, as far as they go; null without a valid date."""
    day = F.format_string("%04d-%02d-%02d", d["year"], d["month"], d["day"])
    clock = F.format_string("T%02d:%02d:%02d", t["hours"], F.coalesce(t["minutes"], F.lit(0)), F.coalesce(t["seconds"], F.lit(0)))
    return F.when(d["valid"], F.concat(day, F.when(t["valid"], clock).otherwise(F.lit(""))))


def fhir_identifier(uid: Column) -> Column:
    return F.concat(F.lit("urn:oid:"), uid)
