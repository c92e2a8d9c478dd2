"""Every query of the library, with the SQL that says the same."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolith.functions import charset as C
from radiolith.functions import tags as T
from radiolith.functions import uids as U
from radiolith.functions import values as V
from radiolith.operators import deident as X
from radiolith.operators import diagnostics as W
from radiolith.operators import dictionary as D
from radiolith.operators import elements as E
from radiolith.operators import phi_scan, profiles, views
from radiolith.sources import reader

from . import bridge as B
from . import deep

FLAGSHIP = "index_studies"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _with(bridge: str, sql: str) -> str:
    return f"with {bridge} {sql}"


_S, _I = B.STUDIES_SQL, B.IMAGES_SQL
_NAME = "split_part(replace(c_name, '#', '^'), '^', {})"


@_query(_with(_S, f"select object_id, cast(c_custkey as varchar) as patient_id, n_name as issuer, {_NAME.format(1)} as family, {_NAME.format(2)} as given, concat('1.2.840.', object_id) as study_uid, object_id as accession, cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, cast(day(o_orderdate) as integer) as day, cast(hour(o_orderdate) as integer) as hours, o_orderpriority as description, concat(n_name, '|', c_custkey) as routing_key, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as started from b"))
def index_studies(spark, sf):
    return views.index_studies(B.studies(spark, sf))


@_query(_with(_S, "select object_id, tag, cast(concat('0x', substr(tag, 1, 4)) as integer) as grp, cast(concat('0x', substr(tag, 5, 4)) as integer) as element, tag as joined from e"))
def tag_split_join(spark, sf):
    g, e = T.tag_group(F.col("tag")), T.tag_element(F.col("tag"))
    return B.studies(spark, sf).select("object_id", "tag", g.alias("grp"), e.alias("element"), T.join_tag(g, e).alias("joined"))


@_query(_with(_S, "select object_id, tag, regexp_full_match(tag, '[0-9A-F]{8}') as valid, regexp_full_match(concat(lower(tag), 'g'), '[0-9A-F]{8}') as bad, cast(concat('0x', substr(tag, 1, 4)) as integer) % 2 = 1 as private, substr(tag, 1, 4) = '0002' as meta, concat(substr(tag, 1, 4), 'XX', substr(tag, 7, 2)) as key from e"))
def tag_predicates(spark, sf):
    t = F.col("tag")
    return B.studies(spark, sf).select("object_id", "tag", T.is_valid_tag(t).alias("valid"), T.is_valid_tag(F.concat(F.lower(t), F.lit("g"))).alias("bad"), T.is_private_tag(t).alias("private"), T.is_file_meta_tag(t).alias("meta"), T.canonical_private_key(t).alias("key"))


@_query(_with(_S, "select object_id, value from e where tag = '0020000D'"))
def get_tag(spark, sf):
    return E.get_tag(B.studies(spark, sf), "0020000d").select("object_id", "value")


@_query(_with(_S, "select object_id, bool_or(tag = '00100040') and bool_or(value = 'BUILDING') as present from e where value <> '' group by object_id"))
def has_tag(spark, sf):
    rows = B.studies(spark, sf).where("tag <> '00100040' or value = 'BUILDING'")
    return E.has_tag(rows, "00100040")


@_query(_with(_S, "select object_id, ord, tag, vr, value, cast(octet_length(encode(value)) as bigint) as length from e"))
def elements_scan(spark, sf):
    return B.studies(spark, sf).select("object_id", "ord", "tag", "vr", "value", "length")


@_query(_with(_S, "select object_id, count(*) filter (tag = '00081030') as n, max(case when tag = '00081030' then value end) as first from e group by object_id"))
def getall(spark, sf):
    return E.get_all(B.studies(spark, sf), "00081030").select("object_id", F.size("values").cast("bigint").alias("n"), F.get("values", 0).alias("first"))


@_query("select doc_id, length(text) as n, regexp_replace(concat(text, '  ', chr(0), ' '), '[ \\x00]+$', '') = rtrim(text) as same, true as ui_space, false as null_pad from documents")
def pad_strip(spark, sf):
    d, v = B.table(spark, sf, "documents"), F.concat("text", F.lit("  \x00 "))
    return d.select("doc_id", F.length("text").cast("bigint").alias("n"), (V.strip_pad(v) == F.rtrim("text")).alias("same"), V.ui_trailing_space(v).alias("ui_space"), V.trailing_null(v).alias("null_pad"))


@_query("select p_partkey, cast(len(l) as integer) as n, l[1] as first, l[2] as second, l[3] as third from (select p_partkey, [p_name, p_brand, p_type] as l from part)")
def multi_value_split(spark, sf):
    s = V.split_values(F.concat(F.lit(" "), F.col("p_name"), F.lit(" \\"), F.col("p_brand"), F.lit("\\ "), F.col("p_type"), F.lit("  ")))
    return B.table(spark, sf, "part").select("p_partkey", F.size(s).alias("n"), F.get(s, 0).alias("first"), F.get(s, 1).alias("second"), F.get(s, 2).alias("third"))


@_query("select doc_id, md5(rtrim(concat('  ', text, chr(92), 'x'))) as digest from documents")
def text_single_value(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.md5(V.strip_pad(F.concat(F.lit("  "), F.col("text"), F.lit("\\x ")))).alias("digest"))


@_query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(cast(l_extendedprice as decimal(18,2)) as double) as ok, cast(null as double) as infinite, cast(null as double) as suffix, 1.5e2::double as exponent, cast(l_quantity as bigint) as whole, cast(null as bigint) as part, cast(null as bigint) as over from lineitem")
def ds_is_decode(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    q = F.col("l_quantity").cast("int").cast("string")
    ds, is_ = V.decimal_string, V.integer_string
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ds(price).alias("ok"), ds(F.lit("1e999")).alias("infinite"), ds(F.concat(q, F.lit("d"))).alias("suffix"), ds(F.lit("1.5e2")).alias("exponent"), is_(q).alias("whole"), is_(price).alias("part"), is_(F.concat(q, F.lit("00000000000000000000"))).alias("over"))


@_query("select o_orderkey, true as valid, cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, cast(day(o_orderdate) as integer) as day, true as dotted_legacy, true as february, false as month_13, cast(hour(o_orderdate) as integer) as hours, cast(minute(o_orderdate) as integer) as minutes, true as leap, false as hour_24 from orders")
def da_tm_decode(spark, sf):
    d = V.parse_date(F.date_format("o_orderdate", "yyyyMMdd"))
    t = V.parse_time(F.date_format("o_orderdate", "HHmm"))
    return B.table(spark, sf, "orders").select("o_orderkey", d["valid"].alias("valid"), d["year"].alias("year"), d["month"].alias("month"), d["day"].alias("day"), V.parse_date(F.date_format("o_orderdate", "yyyy.MM.dd"))["legacy"].alias("dotted_legacy"), V.parse_date(F.lit("20240230"))["valid"].alias("february"), V.parse_date(F.lit("20241301"))["valid"].alias("month_13"), t["hours"].alias("hours"), t["minutes"].alias("minutes"), V.parse_time(F.lit("235960"))["valid"].alias("leap"), V.parse_time(F.lit("24"))["valid"].alias("hour_24"))


@_query("select event_id, cast(year(ts) as integer) as year, cast(minute(ts) as integer) as minutes, cast(case when event_id % 3 = 0 then null else (case when event_id % 2 = 0 then 1 else -1 end) * ((event_id % 12) * 60 + 30) end as integer) as offset_minutes, event_id % 3 = 0 as odd_offset from events")
def dt_decode(spark, sf):
    sign = F.when(F.col("event_id") % 2 == 0, "+").otherwise("-")
    off = F.when(F.col("event_id") % 3 == 0, "99").otherwise(F.concat(F.lpad((F.col("event_id") % 12).cast("string"), 2, "0"), F.lit("30")))
    d = V.parse_date_time(F.concat(F.date_format("ts", "yyyyMMddHHmmss"), sign, off))
    return B.table(spark, sf, "events").select("event_id", d["year"].alias("year"), d["minutes"].alias("minutes"), d["offset_minutes"].alias("offset_minutes"), d["odd_offset"].alias("odd_offset"))


@_query(f"select c_custkey, {_NAME.format(1)} as family, {_NAME.format(2)} as given, '' as middle, c_mktsegment as ideographic, true as no_phonetic from customer")
def pn_decode(spark, sf):
    n = V.parse_person_name(F.concat(F.replace("c_name", F.lit("#"), F.lit("^")), F.lit("="), F.col("c_mktsegment")))
    return B.table(spark, sf, "customer").select("c_custkey", n["alphabetic"]["family"].alias("family"), n["alphabetic"]["given"].alias("given"), n["alphabetic"]["middle"].alias("middle"), n["ideographic"]["family"].alias("ideographic"), n["phonetic"].isNull().alias("no_phonetic"))


@_query("select p_partkey, cast(p_partkey % 65536 as bigint) as us, cast(case when p_partkey % 65536 >= 32768 then p_partkey % 65536 - 65536 else p_partkey % 65536 end as bigint) as ss, cast(p_partkey as bigint) as ul, cast(-1 as bigint) as sl, '18446744073709551615' as uv, cast(2 as integer) as units from part")
def binary_int_decode(spark, sf):
    k = F.col("p_partkey")
    be = F.unhex(F.concat(F.lpad(F.hex(k % 65536), 4, "0"), F.lpad(F.hex(k % 65536), 4, "0"), F.lit("AB")))
    h = F.lpad(F.hex(k), 8, "0")
    le = F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))
    ones, big, small = F.unhex(F.lit("FF" * 8)), F.lit(False), F.lit(True)
    us = V.binary_integers(be, 2, False, big)
    return B.table(spark, sf, "part").select("p_partkey", F.get(us, 0).alias("us"), F.get(V.binary_integers(be, 2, True, big), 1).alias("ss"), F.get(V.binary_integers(le, 4, False, small), 0).alias("ul"), F.get(V.binary_integers(ones, 4, True, small), 0).alias("sl"), F.get(V.binary_integers(ones, 8, False, small), 0).cast("string").alias("uv"), F.size(us).alias("units"))


@_query(_with(_S, "select object_id, ord, tag as little, tag as big from e"))
def at_decode(spark, sf):
    t = F.col("tag")
    le = F.unhex(F.concat(F.substring(t, 3, 2), F.substring(t, 1, 2), F.substring(t, 7, 2), F.substring(t, 5, 2)))
    return B.studies(spark, sf).select("object_id", "ord", F.get(V.attribute_tags(le, F.lit(True)), 0).alias("little"), F.get(V.attribute_tags(F.unhex(t), F.lit(False)), 0).alias("big"))


@_query("select doc_id, octet_length(encode(text)) > length(text) as wide from documents")
def ascii_flag(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", V.non_ascii(V.ascii_text(F.encode("text", "UTF-8"))).alias("wide"))


_TERMS = "case doc_id % 4 when 0 then 'ISO_IR 192' when 1 then chr(92) || 'ISO 2022 IR 87' when 2 then 'ISO_IR 9999' else 'ISO_IR 100' end"


@_query(f"select doc_id, cast(len(t) as integer) as n, case doc_id % 4 when 0 then 'utf-8' when 1 then 'iso-2022-jp' else 'latin1' end as label, case doc_id % 4 when 2 then '<withheld>' else t[len(t)] end as shown from (select doc_id, string_split({_TERMS}, chr(92)) as t from documents)")
def charset_terms(spark, sf):
    m = F.col("doc_id") % 4
    raw = F.when(m == 0, "ISO_IR 192 ").when(m == 1, "\\ISO 2022 IR 87").when(m == 2, "ISO_IR 9999 ").otherwise("ISO_IR 100")
    t = C.parse_terms(raw)
    return B.table(spark, sf, "documents").select("doc_id", F.size(t).alias("n"), C.decoder_label(t).alias("label"), F.element_at(C.withhold_unknown(t), -1).alias("shown"))


@_query("select doc_id, md5(text) as digest from documents")
def charset_decode(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.md5(C.decode_text(F.encode("text", "UTF-8"), F.lit("utf-8"))).alias("digest"))


@_query(_with(_S, "select object_id, cast(c_custkey as varchar) as id, n_name as issuer_of_id, " + _NAME.format(1) + " as family, cast(null as integer) as birth_year, c_mktsegment as sex from b"))
def patient_view(spark, sf):
    return views.patient_view(B.studies(spark, sf)).select("object_id", "id", "issuer_of_id", F.col("name.alphabetic.family").alias("family"), F.col("birth_date.year").alias("birth_year"), "sex")


@_query(_with(_S, "select object_id, concat('1.2.840.', object_id) as instance_uid, cast(null as varchar) as id, object_id as accession_number, cast(day(o_orderdate) as integer) as day, cast(second(o_orderdate) as integer) as seconds, o_orderpriority as description from b"))
def study_view(spark, sf):
    return views.study_view(B.studies(spark, sf)).select("object_id", "instance_uid", "id", "accession_number", F.col("date.day").alias("day"), F.col("time.seconds").alias("seconds"), "description")


@_query(_with(_I, "select object_id, series as instance_uid, number, modality, cast(null as varchar) as description from w"))
def series_view(spark, sf):
    return views.series_view(B.images(spark, sf)).drop("frame_of_reference_uid")


@_query(_with(_I, "select object_id, sop as sop_instance_uid, cast(q as double) as rows, cast(price as double) as rescale_slope, cast(3 as integer) as n_centers, cast(null as double) as bad_center, cast(q as double) as last_center, case pr when 0 then false when 1 then true end as signed from w"))
def image_view(spark, sf):
    return _image(views.image_view(B.images(spark, sf)))


def _image(v):
    return v.select("object_id", "sop_instance_uid", "rows", "rescale_slope", F.size("window_center").alias("n_centers"), F.get("window_center", 1).alias("bad_center"), F.get("window_center", 2).alias("last_center"), "signed")


@_query(_SQL["image_view"])
def parse_files(spark, sf):
    content = B.image_files(spark, sf, tuple(D.TRANSFER_SYNTAXES))
    return _image(views.image_view_of_files(reader.parse_content(content)))


@_query(_with(_S, "select object_id, cast(ord as integer) as ord, tag, vr, rtrim(value, ' ') as value from e"))
def serialize_round_trip(spark, sf):
    content = B.part10(B.studies(spark, sf), B.syntax_of([u for u, kind in D.TRANSFER_SYNTAXES.items() if kind != "implicit-le"]))
    return reader.elements(reader.parse_content(content)).select("object_id", "ord", "tag", "vr", V.strip_pad(F.col("value")).alias("value"))


@_query(_with(_I, "select object_id as path, 8 as n, q as rows from w"))
def base64_objects(spark, sf):
    content = B.image_files(spark, sf, ("1.2.840.10008.1.2.1",))
    texts = content.select("path", F.concat(F.lit("see "), F.regexp_replace(F.base64("content"), r"\s", ""), F.lit(" end")).alias("text"))
    found = reader.parse_content(phi_scan.base64_objects(texts, "path", "text"))
    rows = F.array_max(F.transform(E.tagged(["00280010"], root=False), lambda e: views.first_number(e["value"])))
    found = found.where(F.size("elements") > 0).select(F.substring_index("object_id", "#", 1).alias("path"), F.size("elements").alias("n"), rows.alias("rows"))
    return found.groupBy("path").agg(F.sum("n").cast("int").alias("n"), F.max("rows").cast("int").alias("rows"))


@_query("select l_orderkey, l_linenumber, l_extendedprice as double_back, cast(cast(l_tax as float) as double) as float_back from lineitem")
def binary_float_decode(spark, sf):
    def pack(batches):
        for b in batches:
            yield b.assign(raw=[struct.pack("<df", x, y) for x, y in zip(b.l_extendedprice, b.l_tax, strict=True)]).drop(columns=["l_extendedprice", "l_tax"])

    own = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    rows = own.mapInPandas(pack, "l_orderkey long, l_linenumber int, raw binary")
    wide, narrow = (F.get(V.floats(F.substring("raw", at, n), n, F.lit(True)), 0) for at, n in ((1, 8), (9, 4)))
    return rows.select("l_orderkey", "l_linenumber", wide.alias("double_back"), narrow.alias("float_back"))


@_query("""select event_id, cast(f as integer) as frame, case when event_id % 4 = 3 and f = 1 then 'MISSING_REQUIRED_FUNCTIONAL_GROUP' end as error,
  case when event_id % 4 = 3 and f = 1 then null when event_id % 4 = 2 and f = 1 then 1.5 when event_id % 4 = 3 then 2.5 else 0.5 end as spacing, cast(event_id * 2 + f as double) as z
  from events, unnest([0, 1]) t(f)""")
def frames_resolve(spark, sf):
    n = F.col("event_id")
    row = lambda path, tag, vr, value, count=None: F.struct(F.lit(path).alias("path"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), value.cast("string").alias("value"), F.lit(count).cast("int").alias("item_count"))
    cells = [row("", "00280008", "IS", F.lit(2)), row("", views.PER_FRAME, "SQ", F.lit(""), 2), row("", views.SHARED, "SQ", F.lit(""), 1)]
    shared, measures = f"{views.SHARED}[0]", f"{views.PER_FRAME}[%d]/00289110[0]"
    cells += [row(shared, "00209116", "SQ", F.lit(""), 1), row(shared + "/00209116[0]", "00200037", "DS", F.lit("1\\0\\0\\0\\1\\0"))]
    for f in (0, 1):
        own = f"{views.PER_FRAME}[{f}]"
        cells += [row(own, "00209113", "SQ", F.lit(""), 1), row(own + "/00209113[0]", "00200032", "DS", F.concat(F.lit("0\\0\\"), (n * 2 + f).cast("string")))]
    only = lambda condition, *rows: [F.when(condition, r) for r in rows]
    cells += only(n % 4 != 3, row(shared, "00289110", "SQ", F.lit(""), 1), row(shared + "/00289110[0]", "00280030", "DS", F.lit("0.5\\0.5")))
    cells += only(n % 4 == 2, row(f"{views.PER_FRAME}[1]", "00289110", "SQ", F.lit(""), 1), row(measures % 1, "00280030", "DS", F.lit("1.5\\1.5")))
    cells += only(n % 4 == 3, row(f"{views.PER_FRAME}[0]", "00289110", "SQ", F.lit(""), 1), row(measures % 0, "00280030", "DS", F.lit("2.5\\2.5")))
    rows = B.table(spark, sf, "events").select(n.alias("object_id"), F.explode(F.array_compact(F.array(*cells))).alias("x")).select("object_id", "x.*")
    out = views.frames(rows)
    return out.select(F.col("object_id").alias("event_id"), "frame", "error", F.get("pixel_measures.pixel_spacing", 0).alias("spacing"), F.get("plane_position.image_position_patient", 2).alias("z"))


@_query("select cast(conv_id as varchar) as object_id, cast(turn as integer) as item, md5(text) as text, role as concept from conversations")
def nested_items(spark, sf):
    s = B.sequences(spark, sf)
    texts = E.items_of(s, "0040A730").where("tag = '0040A160'").select("object_id", "item", F.md5("value").alias("text"))
    roles = s.where("tag = '00080104'").select(F.col("object_id").alias("o"), F.regexp_extract("path", r"\[([0-9]+)\]", 1).try_cast("int").alias("i"), F.col("value").alias("concept"))
    return texts.join(roles, (F.col("object_id") == F.col("o")) & (F.col("item") == F.col("i"))).select("object_id", "item", "text", "concept")


@_query("select o_orderkey, cast(f as integer) as frame, case when f % 2 = 0 then o_totalprice else cast(o_custkey as double) end as value from orders, unnest([0, 1, 2]) as t(f)")
def frame_macros(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_totalprice").alias("own"), F.col("o_custkey").cast("double").alias("all"))
    frames = o.select("object_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("frame"))
    per = frames.where("frame % 2 = 0").join(o, "object_id").select("object_id", "frame", F.struct(F.col("own").alias("v")).alias("macro"))
    out = views.frame_macros(frames, per, o.select("object_id", F.struct(F.col("all").alias("v")).alias("macro")))
    return out.select(F.col("object_id").alias("o_orderkey"), "frame", F.col("macro.v").alias("value"))


@_query("select p_partkey, case when p_size % 7 >= 3 then 'FRAME_INDEX_OUT_OF_RANGE' when p_size % 2 = 0 then 'MISSING_REQUIRED_FUNCTIONAL_GROUP' end as code from part")
def frame_errors(spark, sf):
    macros = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("00289110"))).otherwise(F.array(*[F.lit(m) for m in views.REQUIRED_MACROS]))
    return B.table(spark, sf, "part").select("p_partkey", views.frame_error(F.col("p_size") % 7, F.lit(3), macros).alias("code"))


@_query("select event_id, case event_id % 5 when 0 then '1.2.840.10008.2.16.4' when 1 then '2.16.840.1.113883.6.96' when 2 then '2.16.840.1.113883.6.8' when 3 then '2.16.840.1.113883.6.1' end as scheme_uid from events")
def scheme_oid(spark, sf):
    names = F.array(*[F.lit(x) for x in ("DCM", "SCT", "UCUM", "LN", "toString")])
    return B.table(spark, sf, "events").select("event_id", views.coding_scheme_oid(F.get(names, (F.col("event_id") % 5).cast("int"))).alias("scheme_uid"))


@_query(_with(_S, "select object_id, concat(n_name, '|', c_custkey) as routing_key, concat('urn:oid:1.2.840.', object_id) as identifier from b"))
def fhir_bridge(spark, sf):
    v = views.view(B.studies(spark, sf), {"p": ("00100020", "S"), "i": ("00100021", "S"), "u": ("0020000D", "S")})
    return v.select("object_id", views.routing_key(F.col("i"), F.col("p")).alias("routing_key"), views.fhir_identifier(F.col("u")).alias("identifier"))


_LINES = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) as ord from lineitem"


def _lines(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("object_id"), F.lit("").alias("path"), F.col("l_linenumber").cast("string").alias("tag"), "l_partkey", F.row_number().over(w).alias("ord"))


@_query(f"select l_orderkey as object_id, cast(l_linenumber as varchar) as tag, cast(min(ord) as integer) as pos, arg_max(l_partkey, ord) as l_partkey, count(*) - 1 as repeats from ({_LINES}) group by all")
def dedup_last_wins(spark, sf):
    return E.last_wins(_lines(spark, sf), "l_partkey").drop("path")


@_query(f"select l_orderkey as object_id, cast(l_linenumber as varchar) as tag, arg_min(l_partkey, ord) as l_partkey from ({_LINES}) group by all")
def filemeta_first_wins(spark, sf):
    return E.first_wins(_lines(spark, sf), "l_partkey")


@_query("select event_id, concat('000200', case event_id % 3 when 0 then '10' when 1 then '17' else '18' end) as tag from events where event_id % 3 <> 0")
def filemeta_residue(spark, sf):
    low = F.element_at(F.array(F.lit("10"), F.lit("17"), F.lit("18")), (F.col("event_id") % 3 + 1).cast("int"))
    return E.file_meta_residue(B.table(spark, sf, "events").select("event_id", F.concat(F.lit("000200"), low).alias("tag")))


@_query("select event_id, case event_id % 3 when 0 then 'implicit-le' when 1 then 'deflated-le' end as parser, case event_id % 3 when 2 then 'JPEG Baseline (Process 1)' when 1 then 'Deflated Explicit VR Little Endian' else 'Implicit VR Little Endian' end as uid_name from events")
def transfer_syntax_dispatch(spark, sf):
    ends = F.element_at(F.array(F.lit(""), F.lit(".1.99"), F.lit(".4.50")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = B.table(spark, sf, "events").select("event_id", F.concat(F.lit("1.2.840.10008.1.2"), ends).alias("uid"))
    return D.lookup_uid(rows, "uid", D.uids(spark)).select("event_id", D.transfer_syntax(F.col("uid")).alias("parser"), F.substring_index("uid_name", ":", 1).alias("uid_name"))


@_query("select event_id, case event_id % 3 when 0 then '00100010' when 1 then '00100010' end as tag, case event_id % 3 when 2 then null else 'PN' end as vr, case event_id % 3 when 2 then null else 'PatientName' end as keyword from events")
def dict_lookup(spark, sf):
    words = F.element_at(F.array(F.lit("PatientName"), F.lit("00100010"), F.lit("patientname")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = B.table(spark, sf, "events").select("event_id", words.alias("q"))
    return D.lookup(rows, "q", D.attributes(spark)).drop("q")


@_query("select event_id, case event_id % 5 when 0 then 'PN' when 1 then 'LO' when 2 then 'UN' when 3 then 'OW' else 'UN' end as resolved_vr from events")
def implicit_vr_resolution(spark, sf):
    t = F.element_at(F.array(*[F.lit(x) for x in ("00100010", "00290010", "00291008", "60023000", "00990000")]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = B.table(spark, sf, "events").select("event_id", t.alias("tag"))
    return D.resolve_implicit_vr(rows, D.attributes(spark), D.families(spark)).drop("tag")


@_query(_with(_S, "select object_id, cast(ord as integer) as ord, tag, 'UN' as vr, vr as registered from e where tag in ('00100020', '00100021')"))
def vr_mismatch(spark, sf):
    rows = B.studies(spark, sf).withColumn("vr", F.when(F.col("tag").isin("00100020", "00100021"), "UN").otherwise(F.col("vr")))
    return W.vr_mismatches(rows, D.attributes(spark))


@_query("select event_id, event_id % 64 < 32 and event_id % 2 = 0 and event_id % 64 <= 30 as covered from events")
def repeating_mask_match(spark, sf):
    tag = F.concat(F.lit("60"), F.lpad(F.hex(F.col("event_id") % 64), 2, "0"), F.lit("3000"))
    return B.table(spark, sf, "events").select("event_id", D.matches_mask(F.lit("60xx3000"), tag).alias("covered"))


@_query("select concat('50', lpad(printf('%X', 2 * i), 2, '0')) as grp, 'X' as basic from range(0, 16) as t(i)")
def repeating_expand(spark, sf):
    return D.masked_groups(spark).select("grp", "basic")


@_query(_with(_S, "select object_id, cast(ord as integer) as ord, 'ACME 1.0' as private_creator from e where tag = '00091001'"))
def private_creator_resolve(spark, sf):
    return E.resolve_creators(B.studies(spark, sf)).where("private_creator is not null").select("object_id", "ord", "private_creator")


@_query("select event_id, case when event_id % 2 = 0 then 'DiffusionBValue' end as keyword, case when event_id % 2 = 0 then 'GEMS_PARM_01' else '<withheld>' end as shown from events")
def private_overlay(spark, sf):
    rows = B.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "GEMS_PARM_01").otherwise("OTHER").alias("c"), F.lit("00431039").alias("tag"))
    return profiles.resolve_private(rows, profiles.GE, creator="c").select("event_id", F.col("private_keyword").alias("keyword"), F.col("shown_creator").alias("shown"))


@_query("select event_id, case when event_id % 3 = 0 then 'own' else 'root' end as charset from events")
def charset_inherit(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("object_id"), "event_id")
    one = lambda path, at, tag, value: F.struct(F.lit(path).alias("path"), F.lit(at).alias("ord"), F.lit(tag).alias("tag"), value.alias("value"))
    rows = e.select("object_id", "event_id", F.explode(F.array(one("", 0, "00080005", F.lit("root")), one("00081140[0]", 1, "00080005", F.when(F.col("event_id") % 3 == 0, "own")), one("00081140[0]", 2, "00080060", F.lit("CT")))).alias("x")).select("object_id", "event_id", "x.*")
    return E.carried_charset(rows).where("tag = '00080060'").select("event_id", "charset")


#: The digest's 256 bits, doubled and added up as a number of any length.
_UID = "concat('2.25.', substr(cast(list_reduce([cast((strpos('0123456789abcdef', substr(h, 1 + k // 4, 1)) - 1) >> (3 - k % 4) & 1 as bignum) for k in range(0, 256)], lambda a, x: a + a + x) as varchar), 1, 59))"
_METHOD = X.METHOD + " " * (len(X.METHOD) % 2)
_ADDED = f"select distinct object_id, '00120062' as tag, 'YES ' as value from e union all select distinct object_id, '00120063', '{_METHOD}' from e"


def _all(df: DataFrame) -> DataFrame:
    return df.select("object_id", "tag", F.decode("raw", "UTF-8").alias("value"))


def _shown(df: DataFrame) -> DataFrame:
    return _all(df.where("tag not in ('00120062', '00120063')"))


@_query(_with(_S, f"select object_id, tag, case when tag = '0020000D' then {_UID} else '' end as value from (select *, sha256(value) as h from e) where tag not in ('00090010', '00091001', '00100021', '00081030') union all {_ADDED}"))
def deid_basic(spark, sf):
    return _all(X.deidentify(B.studies(spark, sf))[0])


@_query(_with(_S, "select object_id, tag, case when tag in ('0020000D', '00080020', '00080030') then rtrim(value) else '' end as value from e where tag not in ('00090010', '00091001', '00100021')"))
def deid_retained(spark, sf):
    return _shown(X.deidentify(B.studies(spark, sf), ("RetainUIDs", "RetainLongitudinalTemporal", "CleanDescriptors"))[0])


@_query(_with(_S, "select object_id, tag, value from e where tag in ('00090010', '00091001')"))
def deid_retain_safe_private(spark, sf):
    acme = profiles.define_profile("acme", private={"ACME 1.0": {"0009XX01": ("LO", "Status", "Status")}})
    out, _ = X.deidentify(B.studies(spark, sf), ("RetainSafePrivate",), profile=acme, private_values="kept")
    return _shown(out).where(T.is_private_tag(F.col("tag")))


@_query(_with(_S, "select tag, case when tag in ('00090010', '00091001', '00100021', '00081030') then 'removed' when tag = '0020000D' then 'remapped' else 'emptied' end as applied, count(*) as n from e group by all"))
def deid_audit_counts(spark, sf):
    return X.deidentify(B.studies(spark, sf))[1].groupBy("tag", "applied").agg(F.count("*").alias("n"))


@_query("with u as (select o_orderkey, concat('1.2.840.', o_orderkey) as uid from orders) select o_orderkey, substr(sha256(uid), 1, 16) as head from u")
def uid_digest(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", F.substring(F.sha2(F.concat(F.lit("1.2.840."), F.col("o_orderkey").cast("string")).cast("binary"), 256), 1, 16).alias("head"))


@_query(f"select o_orderkey, {_UID} as uid from (select o_orderkey, sha256(concat('1.2.840.', o_orderkey)) as h from orders)")
def uid_remap(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", U.remap_uid(F.concat(F.lit("1.2.840."), F.col("o_orderkey").cast("string"))).alias("uid"))


@_query(f"with u as (select distinct concat('1.2.840.2.', l_orderkey) as original from lineitem) select original, {_UID} as replacement from (select original, sha256(original) as h from u)")
def uid_map(spark, sf):
    return U.uid_map(B.table(spark, sf, "lineitem").select(F.concat(F.lit("1.2.840.2."), F.col("l_orderkey").cast("string")).alias("uid")), "uid")


@_query("select count(distinct l_orderkey) as series, count(distinct l_orderkey) as mapped from lineitem")
def uid_referential_integrity(spark, sf):
    series = B.table(spark, sf, "lineitem").select("l_orderkey").distinct()
    uid = F.concat(F.lit("1.2.840.2."), F.col("l_orderkey").cast("string"))
    return series.select("l_orderkey", U.remap_uid(uid).alias("m")).agg(F.countDistinct("l_orderkey").alias("series"), F.countDistinct("m").alias("mapped"))


@_query("select cast(conv_id as varchar) as object_id, cast(turn * 10 + 2 as bigint) as ord, case when turn % 5 = 4 then 'unauditable' else 'kept' end as applied from conversations")
def deid_unauditable(spark, sf):
    rows = X.deidentify(B.sequences(spark, sf), actions=D.actions(spark, content=False), scan_embedded=False)[1]
    kept = B.sequences(spark, sf).where("tag = '0040A043'").select(F.col("object_id").alias("o"), F.col("ord").alias("n"))
    return kept.join(rows.select("object_id", "ord", "applied"), (F.col("o") == F.col("object_id")) & (F.col("n") == F.col("ord")), "left").select(F.col("o").alias("object_id"), F.col("n").alias("ord"), F.coalesce("applied", F.lit("kept")).alias("applied"))


@_query("select count(*) as left_over from conversations where turn < 0")
def deid_sequence_removed(spark, sf):
    rules = spark.createDataFrame([("0040A730", "X", {})], "tag string, basic string, options map<string,string>")
    out, _ = X.deidentify(B.sequences(spark, sf), actions=rules, scan_embedded=False)
    return out.where("tag not in ('00120062', '00120063')").agg(F.count("*").alias("left_over"))


@_query("select event_id, event_id % 100 <= 37 as settled from events")
def deid_disputed_boundary(spark, sf):
    n = F.col("event_id") % 100
    rows = B.table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 100).alias("object_id"), F.lit("").alias("path"), n.alias("ord"), (n * 8).alias("byte_offset"), (n == 37).alias("overruns"))
    return E.settled(rows).select("event_id", "settled")


@_query(f"select p_partkey, concat(p_name, chr(92), '{X.METHOD}') as method, length(p_type) > 64 as over from part")
def deid_method_add(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", X.added_method(F.col("p_name"), X.METHOD).alias("method"), X.over_length(F.col("p_type")).alias("over"))


@_query("select event_id as object_id from events where event_id % 2 = 0 and event_id % 3 <> 0")
def deid_burned_in(spark, sf):
    n = F.col("event_id")
    cells = F.array_compact(F.array(F.when(n % 2 == 0, F.struct(F.lit("7FE00010").alias("tag"), F.lit("").alias("value"))), F.struct(F.lit("00280301").alias("tag"), F.when(n % 3 == 0, " no ").otherwise("YES").alias("value"))))
    rows = B.table(spark, sf, "events").select(n.alias("object_id"), F.lit("").alias("path"), F.explode(cells).alias("x")).select("object_id", "path", "x.*")
    return X.burned_in(rows)


@_query("select event_type, event_id from events qualify row_number() over (partition by event_type order by event_id) <= 64")
def audit_cap(spark, sf):
    return W.capped(B.table(spark, sf, "events").select("event_type", "event_id"), ("event_type",), ("event_id",), X.AUDIT_CAP)


@_query("select doc_id, cast((octet_length(encode(text)) + 1) // 2 * 2 as bigint) as size, case when octet_length(encode(text)) % 2 = 1 then '20' end as pad_byte from documents")
def even_padding(spark, sf):
    p = V.pad_even(F.encode("text", "UTF-8"), F.lit("LT"))
    return B.table(spark, sf, "documents").select("doc_id", F.length(p).cast("bigint").alias("size"), F.when(F.octet_length("text") % 2 == 1, F.hex(F.substring(p, -1, 1))).alias("pad_byte"))


@_query(_with(_S, "select object_id, cast(ord as integer) as ord, 'ODD_LENGTH_VALUE_PADDED' as code, concat(case when substr(tag, 4, 1) = '9' then '<withheld>' else tag end, ' has an odd length') as message from e where octet_length(encode(value)) % 2 = 1"))
def warnings_registry_join(spark, sf):
    w = W.structural_warnings(B.studies(spark, sf))
    return W.render(w, W.registry(spark), D.attributes(spark)).select("object_id", "ord", "code", "message")


@_query("select case when event_type = 'click' then 'fatal' else 'kept' end as fate, count(*) as n from events where event_type <> 'view' group by all")
def profile_suppress_escalate(spark, sf):
    rows = B.table(spark, sf, "events").select(F.when(F.col("event_type") == "click", "VR_MISMATCH").when(F.col("event_type") == "view", "MISSING_PREAMBLE").otherwise("SQ_NOT_DESCENDED").alias("code"))
    kept, fatal = W.apply_profile(rows, profiles.STRICT.escalate, profiles.LENIENT.suppress)
    return kept.select(F.lit("kept").alias("fate")).union(fatal.select(F.lit("fatal").alias("fate"))).groupBy("fate").agg(F.count("*").alias("n"))


@_query("select o_orderkey, 'iso_date' as recognizer, strftime(o_orderdate, '%Y-%m-%d') as token from orders union all select o_orderkey, 'compact_date', strftime(o_orderdate, '%Y%m%d') from orders union all select o_orderkey, 'name', concat('DOE^J', chr(cast(65 + o_orderkey % 26 as integer))) from orders where o_orderkey % 26 <> 0")
def phi_scan_text(spark, sf):
    name = F.concat(F.lit(" seen DOE^J"), F.char(F.lit(65) + F.col("o_orderkey") % 26))
    text = F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", file "), F.date_format("o_orderdate", "yyyyMMdd"), name, F.lit("; no 120240101 nor 2024-13-01"))
    allowed = spark.createDataFrame([("DOE^JA",)], "token string")
    return phi_scan.scan_text(B.table(spark, sf, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text", 2026, allowed)


@_query(_with(_S, "select tag, case when tag = '00100010' then 'name' else 'date' end as recognizer, count(*) as n from e where tag in ('00100010', '00080020') group by all"))
def phi_scan_tags(spark, sf):
    return phi_scan.scan_elements(B.studies(spark, sf)).groupBy("tag", "recognizer").agg(F.count("*").alias("n"))


@_query("select coalesce(s_suppkey, c_custkey) as k, coalesce(s_name, c_name) as name, coalesce(s_nationkey, c_nationkey) as nation from supplier full join customer on s_suppkey = c_custkey")
def dictionary_overlay(spark, sf):
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return D.overlay(s, c, "k", ["name", "nation"])


@_query(_with(_S, "select object_id, ord, case when vr = 'UI' then 'strings' when vr = 'PN' then 'personName' when vr = 'DA' then 'dates' when vr = 'TM' then 'times' else 'strings' end as kind from e"))
def value_kinds(spark, sf):
    return B.studies(spark, sf).select("object_id", "ord", V.kind(F.col("vr"), F.col("length")).alias("kind"))


@_query("select event_id, case event_id % 4 when 0 then 'DA_LEGACY_FORMAT' when 1 then 'IS_NONINTEGER_VALUE' when 2 then 'UI_TRAILING_SPACE' end as code from events")
def value_warnings(spark, sf):
    k = (F.col("event_id") % 4 + 1).cast("int")
    vr = F.element_at(F.array(*[F.lit(x) for x in ("DA", "IS", "UI", "LO")]), k)
    value = F.element_at(F.array(*[F.lit(x) for x in ("2024.01.15", "42\\3.5", "1.2 ", "x")]), k)
    return B.table(spark, sf, "events").select("event_id", F.get(W.value_warnings(vr, value), 0).alias("code"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | deep.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | deep.oracle_sql()
