"""Queries over nested data: sequences as bytes, de-identification at depth, scopes, and maps over runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolith.functions import uids as U
from radiolith.functions import values as V
from radiolith.operators import deident as X
from radiolith.operators import diagnostics as W
from radiolith.operators import dictionary as D
from radiolith.operators import elements as E
from radiolith.operators import nesting, phi_scan, profiles, views
from radiolith.sources import reader, writer
from radiolith.streaming import state

from . import bridge as B
from .scratch import scratch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def _cells(base: DataFrame, object_id, rows: list[tuple]) -> DataFrame:
    """Element rows of each row of ``base``; of ``(path, ord, tag, vr, value, item_count, condition)``."""
    one = lambda path, at, tag, vr, value, count: F.struct(F.lit(path).alias("path"), F.lit(at).cast("long").alias("ord"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), value.cast("string").alias("value"), F.lit(count).cast("int").alias("item_count"))
    cells = [F.when(when, one(*r)) if (when := r_[6]) is not None else one(*r) for r_ in rows for r in (r_[:6],)]
    out = base.select(object_id.cast("string").alias("object_id"), F.explode(F.array_compact(F.array(*cells))).alias("e")).select("object_id", "e.*")
    return out.withColumn("raw", F.encode(F.coalesce("value", F.lit("")), "UTF-8"))


def _staged(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: what is dear to compute and read more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a content sequence of two levels; every fifth turn's code sequence has no items."""
    rows = B.sequences(spark, sf)
    bare = (F.col("ord") % 10 == 3) & (F.floor(F.col("ord") / 10) % 5 == 4)
    count = F.when((F.col("tag") == "0040A043"), F.coalesce("item_count", F.lit(0))).otherwise(F.col("item_count"))
    return rows.where(~bare).withColumn("item_count", count).withColumn("encoding", F.lit("explicit-le"))


def _le(n: str, width: int) -> str:
    return "concat(" + ", ".join(f"substr(printf('%08X', {n}), {i}, 2)" for i in range(7, 7 - 2 * width, -2)) + ")"


_EVEN = "cast((octet_length(encode({0})) + 1) // 2 * 2 as integer)"
_PADDED = "concat(hex(encode({0})), case when octet_length(encode({0})) % 2 = 1 then '20' else '' end)"


def _content_sql(text: str) -> str:
    """The content sequence's bytes as hexadecimal digits, by concatenation from the innermost element out."""
    return f"""with c as (select conv_id, turn, {text} as text, role from conversations),
i as (select *, case when turn % 5 = 4 then '' else concat('FEFF00E0', {_le("8 + " + _EVEN.format("role"), 4)}, '080004014C4F', {_le(_EVEN.format("role"), 2)}, {_PADDED.format("role")}) end as codes from c),
b as (select *, concat('400060A155540000', {_le(_EVEN.format("text"), 4)}, {_PADDED.format("text")}, '400043A053510000', {_le("cast(length(codes) // 2 as integer)", 4)}, codes) as body from i),
r as (select conv_id, string_agg(concat('FEFF00E0', {_le("cast(length(body) // 2 as integer)", 4)}, body), '' order by turn) as bytes, count(*) as n from b group by conv_id)
select cast(conv_id as varchar) as object_id, cast(n as integer) as item_count, md5(bytes) as digest, cast(length(bytes) // 2 as bigint) as length from r"""


def _content(rows: DataFrame) -> DataFrame:
    whole = nesting.rebuild(rows).where("tag = '0040A730' and path = ''")
    return whole.select("object_id", "item_count", F.md5(F.hex("raw").cast("binary")).alias("digest"), F.length("raw").cast("bigint").alias("length"))


@_query(_content_sql("text"))
def sequence_rebuild(spark, sf):
    return _content(_turns(spark, sf))


@_query(_content_sql("'ANONYMIZED'"))
def deid_nested_bytes(spark, sf):
    rules = spark.createDataFrame([("0040A160", "D", {})], "tag string, basic string, options map<string,string>")
    return _content(X.deidentify(_turns(spark, sf), actions=rules)[0])


@_query("select cast(conv_id as varchar) as object_id, cast(turn * 10 + 2 as bigint) as ord, cast(turn * 10 + case when turn % 5 = 4 then 2 else 3 end as bigint) as leave from conversations union all select cast(conv_id as varchar), 0, max(turn * 10 + case when turn % 5 = 4 then 2 else 3 end) from conversations group by conv_id")
def sequence_intervals(spark, sf):
    return nesting.intervals(_turns(spark, sf)).where("vr = 'SQ'").select("object_id", "ord", F.col("leave").cast("bigint").alias("leave"))


_CHAIN = "select conv_id, turn // 5 as part, turn % 5 as d, case when length(text) % 3 = 0 then concat('cs-', turn) end as own from conversations"


@_query(f"""with recursive t as ({_CHAIN}), c as (select conv_id, part, d, own as charset from t where d = 0
  union all select t.conv_id, t.part, t.d, coalesce(t.own, c.charset) from c join t on t.conv_id = c.conv_id and t.part = c.part and t.d = c.d + 1)
select concat(conv_id, '.', part) as object_id, cast(d as integer) as depth, charset from c""")
def charset_nested(spark, sf):
    c = B.table(spark, sf, "conversations")
    d = (F.col("turn") % 5).cast("int")
    path = F.array_join(F.array_repeat(F.lit("00081140[0]"), d), "/")
    cells = F.array(*[F.struct((d * 10 + i).alias("ord"), F.lit(t).alias("tag"), F.lit(v).alias("vr"), value.alias("value")) for i, t, v, value in ((1, "00080005", "CS", F.when(F.length("text") % 3 == 0, F.concat(F.lit("cs-"), F.col("turn").cast("string")))), (2, "00080060", "CS", F.lit("CT")), (3, "00081140", "SQ", F.lit("")))])
    rows = c.select(F.concat_ws(".", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 5).cast("string")).alias("object_id"), path.alias("path"), F.explode(cells).alias("e")).select("object_id", "path", "e.*")
    out = E.carried_charset(rows).where("tag = '00080060'")
    return out.select("object_id", nesting.depth(F.col("path")).cast("int").alias("depth"), "charset")


_ACTED = """case when turn % 3 = 0 and o in (2, 3, 4, 5, 6, 7, 9) then 'removed' when turn % 3 = 1 and o in (6, 7) then 'removed'
  when o = 6 then 'emptied' when o = 8 then 'unenumerable' when o = 9 then 'unenumerable' when turn % 3 = 1 and o = 5 then 'unauditable' else 'kept' end"""


@_query(f"select concat(conv_id, '.', turn) as object_id, cast(o as bigint) as ord, {_ACTED} as applied from conversations, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) as t(o) where not (turn % 3 = 1 and o in (6, 7))")
def deid_private_nested(spark, sf):
    """Private sequences three levels deep: a foreign creator in an item, an innermost one without items, and values that cannot be looked into."""
    one, two = "00091001[0]", "00091001[0]/00091001[0]"
    three = two + "/00091001[0]"
    t = F.col("turn") % 3
    acme = F.lit("ACME 1.0")
    rows = [
        ("", 0, "00090010", "LO", acme, None, None), ("", 1, "00091001", "SQ", F.lit(""), 1, None), (one, 2, "00090010", "LO", F.when(t == 0, "OTHER").otherwise(acme), None, None), (one, 3, "00091001", "SQ", F.lit(""), 1, None),
        (two, 4, "00090010", "LO", acme, None, None), (two, 5, "00091001", "SQ", F.lit(""), 1, t != 1), (two, 5, "00091001", "SQ", F.lit(""), None, t == 1), (three, 6, "00100010", "PN", F.col("role"), None, t != 1), (three, 7, "00080060", "CS", F.lit("CT"), None, t != 1),
        (one, 9, "00091002", "LO", F.col("role"), None, None), ("", 8, "00091003", "LO", F.col("role"), None, None),
    ]
    base = B.table(spark, sf, "conversations")
    cells = _cells(base, F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")), rows)
    # in the order of reading the item's value comes before the root's
    cells = cells.withColumn("ord", F.when(F.col("ord") == 8, 99).otherwise(F.col("ord")))
    private = {"ACME 1.0": {"0009XX01": ("SQ", "Items", "Items"), "0009XX02": ("LO", "Inner", "Inner"), "0009XX03": ("LO", "Outer", "Outer")}}
    rules = D.actions(spark)
    audit = X.deidentify(cells, ("RetainSafePrivate",), profile=profiles.define_profile("acme", private=private), actions=rules)[1]
    seen = cells.select(F.col("object_id").alias("o"), F.col("ord").alias("n")).join(audit, (F.col("o") == F.col("object_id")) & (F.col("n") == F.col("ord")), "left")
    return seen.select(F.col("o").alias("object_id"), F.when(F.col("n") == 99, 8).otherwise(F.col("n")).cast("bigint").alias("ord"), F.coalesce("applied", F.lit("kept")).alias("applied"))


_UID = "concat('2.25.', substr(cast(list_reduce([cast((strpos('0123456789abcdef', substr(h, 1 + k // 4, 1)) - 1) >> (3 - k % 4) & 1 as bignum) for k in range(0, 256)], lambda a, x: a + a + x) as varchar), 1, 59))"


@_query(f"""with u as (select distinct concat('1.2.840.2.', l_orderkey) as original, l_orderkey from lineitem), g as (select concat('1.2.840.2.', o_orderkey) as original, concat('9.9.', o_orderkey) as replacement from orders where o_orderpriority = '1-URGENT')
select original, replacement from g union all select original, {_UID} from (select original, sha256(original) as h from u where original not in (select original from g))""")
def uid_map_runs(spark, sf):
    """Two runs over overlapping line items: given replacements win, and what the first run derived stays."""
    uid = F.concat(F.lit("1.2.840.2."), F.col("l_orderkey").cast("string")).alias("uid")
    given = B.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("1.2.840.2."), F.col("o_orderkey").cast("string")).alias("original"), F.concat(F.lit("9.9."), F.col("o_orderkey").cast("string")).alias("replacement"))
    lines = B.table(spark, sf, "lineitem")
    first = U.extend_map(given, lines.where("l_returnflag = 'R'").select(uid), "uid")
    return U.extend_map(first, lines.select(uid), "uid")


@_query(f"""with c as (select concat('p', c_custkey) as object_id, concat('1.2.840.3.', c_custkey) as uid, * from customer), h as (select *, sha256(uid) as h from c)
select object_id, '' as path, '00080018' as tag, {_UID} as value from h union all select object_id, '', '00100010', '' from h union all select object_id, '', '00100020', '' from h union all select object_id, '', '00100040', '' from h
union all select object_id, '', '00120062', 'YES' from h union all select object_id, '', '00120063', '{X.METHOD}' from h
union all select object_id, '', '00400555', '' from h union all select object_id, '00400555[0]', '00080060', case when c_custkey % 2 = 0 then 'CT' else 'MR' end from h union all select object_id, '00400555[0]', '00100010', '' from h
union all select object_id, 'meta', '00020003', {_UID} from h""")
def deid_parsed(spark, sf):
    """Customers as files, read, de-identified with their file meta, written and read again."""
    rows = _cells(B.table(spark, sf, "customer"), F.concat(F.lit("p"), F.col("c_custkey").cast("string")), [
        ("", 0, "00080018", "UI", F.concat(F.lit("1.2.840.3."), F.col("c_custkey").cast("string")), None, None), ("", 1, "00100010", "PN", F.replace("c_name", F.lit("#"), F.lit("^")), None, None), ("", 2, "00100020", "LO", F.col("c_custkey"), None, None),
        ("", 3, "00100040", "CS", F.col("c_mktsegment"), None, None), ("", 4, "00101002", "SQ", F.lit(""), 1, None), ("00101002[0]", 5, "00100020", "LO", F.col("c_name"), None, None),
        ("", 6, "00400555", "SQ", F.lit(""), 1, None), ("00400555[0]", 7, "00080060", "CS", F.when(F.col("c_custkey") % 2 == 0, "CT").otherwise("MR"), None, None), ("00400555[0]", 8, "00100010", "PN", F.col("c_name"), None, None),
    ])
    meta = F.create_map(F.lit("transfer_syntax_uid"), F.lit("1.2.840.10008.1.2.1"), F.lit("media_storage_sop_instance_uid"), F.concat(F.lit("1.2.840.3."), F.substring("object_id", 2, 20)))
    files = rows.select("object_id").distinct().select("object_id", meta.alias("meta"), F.array().cast("array<struct<tag:string,vr:string,value:binary>>").alias("residue"))
    parsed = _staged(reader.parse_content(writer.serialize(files, rows).select(F.col("object_id").alias("path"), "content")), "parsed")
    rules = D.actions(spark).where("tag <> '00400555'")
    done = X.deidentify_files(parsed, reader.elements(parsed), actions=rules)
    again = reader.parse_content(writer.serialize(done.files, _staged(done.elements, "deidentified")).select(F.col("object_id").alias("path"), "content"))
    meta = again.select("object_id", F.lit("meta").alias("path"), F.lit("00020003").alias("tag"), F.element_at("meta", "media_storage_sop_instance_uid").alias("value"))
    plain = reader.elements(again).select("object_id", "path", "tag", F.when(F.col("vr") == "SQ", "").otherwise(V.strip_pad(F.col("value"))).alias("value"))
    return plain.union(meta)


@_query("select p_partkey as object_id, 'PIXEL_DATA_LENGTH_MISMATCH' as code, cast((p_size * (p_partkey % 7 + 1) * 2 + 1) // 2 * 2 as bigint) as expected, cast(p_size * (p_partkey % 7 + 1) * 2 + 2 as bigint) as length from part where p_partkey % 5 = 1")
def pixel_lengths(spark, sf):
    """Images of ``p_size`` rows and up to seven columns of 16 bits: every fifth has two bytes too many, others are right or encapsulated."""
    k = F.col("p_partkey")
    two = lambda n: F.unhex(F.concat(F.lpad(F.hex(n.cast("long")), 2, "0"), F.lit("00")))
    size = (F.col("p_size") * (k % 7 + 1) * 2 + F.when(k % 5 == 1, 2).otherwise(0)).cast("int")
    cell = lambda tag, vr, raw, count=None: F.struct(F.lit("").alias("path"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), raw.alias("raw"), F.lit(count).cast("int").alias("item_count")) if not hasattr(count, "alias") else F.struct(F.lit("").alias("path"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), raw.alias("raw"), count.alias("item_count"))
    cells = F.array(cell("00280010", "US", two(F.col("p_size"))), cell("00280011", "US", two(k % 7 + 1)), cell("00280100", "US", two(F.lit(16))), cell("7FE00010", "OW", F.unhex(F.repeat(F.lit("AB"), F.when(k % 5 == 2, 6).otherwise(size))), F.when(k % 5 == 2, 2).cast("int")))
    rows = B.table(spark, sf, "part").select(k.alias("object_id"), F.explode(cells).alias("e")).select("object_id", "e.*")
    return W.pixel_length_mismatches(rows.withColumn("little_endian", F.lit(True)).withColumn("length", F.length("raw").cast("bigint")))


@_query("select doc_id from documents where doc_id % 2 = 1 and length(text) % 3 <> 0 union all select doc_id from documents where doc_id % 2 = 0 and length(text) % 3 = 1")
def ambiguous_separators(spark, sf):
    """Texts that end in a character of two bytes with a backslash's byte, in a plain backslash, or in neither, under two kinds of character sets."""
    gb = F.col("doc_id") % 2 == 1
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x5B\x5D-\x7E]", "")
    two = F.when(gb, F.unhex(F.lit("955C"))).otherwise(F.concat(F.unhex(F.lit("1B2442")), F.unhex(F.lit("255C")), F.unhex(F.lit("1B2842"))))
    rest = F.length("text") % 3
    end = F.when(rest == 0, F.unhex(F.lit("5C41"))).when(rest == 1, two).otherwise(F.when(gb, F.unhex(F.lit("8140955C"))).otherwise(F.unhex(F.lit("1B2442253F1B28425C"))))
    charset = F.when(gb, F.array(F.lit("GB18030"))).otherwise(F.array(F.lit(""), F.lit("ISO 2022 IR 87")))
    rows = B.table(spark, sf, "documents").select(F.col("doc_id").alias("object_id"), F.lit(0).alias("ord"), F.lit("00104000").alias("tag"), F.lit("LO").alias("vr"), F.concat(F.encode(plain, "ISO-8859-1"), end).alias("raw"), charset.alias("charset"))
    return W.separator_warnings(rows).select(F.col("object_id").alias("doc_id"))


@_query("select p_partkey, case when p_partkey % 4 = 0 then 'any' when p_partkey % 4 = 1 then 'element' when p_partkey % 4 = 2 then 'exact' end as name from part")
def pattern_matches(spark, sf):
    """Masks of three shapes, of which the one with the fewest wildcards counts."""
    k = F.col("p_partkey")
    tag = F.when(k % 4 == 0, F.concat(F.lit("50"), F.lpad(F.hex(k % 256), 2, "0"), F.lit("1234"))).when(k % 4 == 1, F.concat(F.lit("50"), F.lpad(F.hex(k % 256), 2, "0"), F.lit("3000"))).when(k % 4 == 2, F.lit("50023000")).otherwise(F.lit("51023000"))
    masks = spark.createDataFrame([("50xxxxxx", "any"), ("50xx3000", "element"), ("50023000", "exact")], "pattern string, name string")
    rows = B.table(spark, sf, "part").select("p_partkey", tag.alias("tag"))
    return D.match_patterns(rows, F.col("tag"), masks, "name", "name").select("p_partkey", "name")


@_query("""select cast(o_orderkey as varchar) as object_id, 'name' as recognizer from orders join customer on o_custkey = c_custkey where o_custkey % 10 <> 3 and c_mktsegment <> 'BUILDING'
union all select cast(o_orderkey as varchar), 'date' from orders where o_orderkey % 50 <> 7 and year(o_orderdate) >= 1995 and day(o_orderdate) <> 15""")
def phi_scan_allowed(spark, sf):
    """Names that are allowed whole or by how they begin, dates that are allowed, too old or in no form."""
    c = B.table(spark, sf, "customer")
    base = B.table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    name = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("TEST^"), F.col("c_name"))).otherwise(F.col("c_name"))
    date = F.when(F.col("o_orderkey") % 50 == 7, F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    rows = _cells(base, F.col("o_orderkey"), [("", 0, "00100010", "PN", F.concat(name, F.lit(" ")), None, None), ("", 1, "00080020", "DA", date, None, None)])
    days = B.table(spark, sf, "orders").where(F.dayofmonth("o_orderdate") == 15).select(F.lit("date").alias("kind"), F.date_format("o_orderdate", "yyyyMMdd").alias("value"))
    allowed = c.where("c_custkey % 10 = 3").select(F.lit("name").alias("kind"), F.col("c_name").alias("value")).union(days).union(spark.createDataFrame([("name_prefix", "TEST^")], "kind string, value string"))
    return phi_scan.scan_elements(rows, allowed, 1995 + phi_scan.YEARS).select("object_id", "recognizer")


@_query("""select cast(user_id as varchar) as object_id, event_type as tag, max(event_id) as version, case when bool_or(bool_or(event_type = 'error' and value > 40)) over (partition by user_id) then 'quarantined' else 'kept' end as fate from events group by user_id, event_type""")
def stream_last_versions(spark, sf):
    """Events as element versions in four files, read one a micro-batch."""
    source, out, at = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-at"))
    code = F.when((F.col("event_type") == "error") & (F.col("value") > 40), "VR_MISMATCH").alias("code")
    rows = B.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("object_id"), F.lit("").alias("path"), F.col("event_type").alias("tag"), F.lit("LO").alias("vr"), F.col("event_id").alias("version"), F.col("ts").cast("timestamp").alias("seen"), F.encode(F.col("value").cast("string"), "UTF-8").alias("raw"), code)
    rows.repartition(4, "version").write.parquet(source)
    state.closing_row(spark, "2200-01-01 00:00:00").coalesce(1).write.mode("append").parquet(source)
    state.stateful(spark)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    last = state.last_versions(stream, "3650 days", frozenset({"VR_MISMATCH"}))
    q = last.writeStream.format("parquet").option("checkpointLocation", at).option("path", out).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(state.ROW).parquet(out).select("object_id", "tag", "version", "fate")


def _items(spark: SparkSession, sf: str, tag: str, rows: list[tuple]) -> DataFrame:
    """Conversations as objects with one sequence, an item a turn; ``(path below the item, tag, representation, value, condition)``."""
    c = B.table(spark, sf, "conversations")
    step = F.concat(F.lit(f"{tag}["), F.col("turn").cast("string"), F.lit("]"))
    one = lambda below, t, v, value, when: F.when(F.lit(True) if when is None else when, F.struct((F.concat(step, F.lit("/" + below)) if below else step).alias("path"), F.lit(t).alias("tag"), F.lit(v).alias("vr"), value.cast("string").alias("value")))
    cells = F.array_compact(F.array(*[one(*r) for r in rows]))
    return c.select(F.col("conv_id").cast("string").alias("object_id"), F.explode(cells).alias("e")).select("object_id", "e.*")


@_query("select cast(conv_id as varchar) as object_id, cast(turn as integer) as item, concat('P', conv_id, '.', turn) as id, case when turn % 2 = 1 then role end as issuer, case when turn % 3 = 2 then 'TEXT' end as type_code from conversations")
def other_patient_ids(spark, sf):
    name = F.concat(F.lit("P"), F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.lit(" "))
    rows = _items(spark, sf, "00101002", [("", "00100020", "LO", name, None), ("", "00100021", "LO", F.col("role"), F.col("turn") % 2 == 1), ("", "00100022", "CS", F.lit("TEXT"), F.col("turn") % 3 == 2), ("00100024[0]", "00100020", "UT", F.lit("deeper"), None)])
    return views.other_patient_ids(rows)


@_query("select cast(conv_id as varchar) as object_id, cast(turn as integer) as item, length(text) / 4.0 as slope, case when turn % 4 <> 1 then cast(-turn as double) end as intercept, case when turn % 3 <> 0 then role end as units from conversations")
def real_world_value_maps(spark, sf):
    rows = _items(spark, sf, "00409096", [("", "00409225", "FD", F.length("text") / 4, None), ("", "00409224", "FD", -F.col("turn"), F.col("turn") % 4 != 1), ("004008EA[0]", "00080100", "SH", F.col("role"), F.col("turn") % 3 != 0), ("004008EA[1]", "00080100", "SH", F.lit("second"), None)])
    return views.real_world_value_maps(rows)


@_query("""select cast(conv_id as varchar) as object_id, cast(turn as bigint) as turn, cast(length(text) as varchar) as value_code, case turn % 6 when 0 then 'DCM' when 1 then 'SCT' when 2 then 'UCUM' when 3 then 'LN' when 4 then 'dcm' end as designator, role as meaning,
  case turn % 6 when 0 then '1.2.840.10008.2.16.4' when 1 then '2.16.840.1.113883.6.96' when 2 then '2.16.840.1.113883.6.8' when 3 then '2.16.840.1.113883.6.1' end as scheme_uid from conversations""")
def coded_concepts(spark, sf):
    names = F.array(*[F.lit(x) for x in ("DCM", "SCT", "UCUM", "LN", "dcm")])
    scheme = F.get(names, (F.col("turn") % 6).cast("int"))
    rows = _items(spark, sf, "0040A730", [("0040A043[0]", "00080100", "SH", F.length("text"), None), ("0040A043[0]", "00080102", "SH", scheme, scheme.isNotNull()), ("0040A043[0]", "00080104", "LO", F.col("role"), None)])
    out = views.coded_concepts(rows, ("object_id", "path"))
    return out.select("object_id", F.regexp_extract("path", r"\[([0-9]+)\]", 1).cast("bigint").alias("turn"), "value_code", "designator", "meaning", "scheme_uid")


@_query("select cast(conv_id as varchar) as object_id, bool_or(turn = 3) as enhanced from conversations group by conv_id")
def functional_groups_test(spark, sf):
    rows = _items(spark, sf, "00081140", [("", "00080060", "CS", F.lit("CT"), None), ("", views.PER_FRAME, "SQ", F.lit(""), None)])
    root = B.table(spark, sf, "conversations").where("turn = 3").select(F.col("conv_id").cast("string").alias("object_id"), F.lit("").alias("path"), F.lit(views.SHARED).alias("tag"), F.lit("SQ").alias("vr"), F.lit("").alias("value"))
    return views.has_functional_groups(rows.unionByName(root))


_BYTES = "array_to_string(list_transform(range(0, cast(length(h) // 2 as integer)), lambda i: chr(cast(concat('0x', substr(h, 2 * i + 1, 2)) as integer))), '')"


@_query(f"select conv_id, turn, md5(case when turn % 2 = 0 then text else {_BYTES} end) as digest from (select *, hex(encode(text)) as h from conversations)")
def charset_by_term(spark, sf):
    """The same bytes under UTF-8 and under Latin-1, by the terms in force at the element."""
    terms = F.when(F.col("turn") % 2 == 0, F.array(F.lit("ISO_IR 192"))).otherwise(F.array(F.lit("ISO_IR 100")))
    rows = B.table(spark, sf, "conversations").select("conv_id", "turn", F.lit("UT").alias("vr"), F.encode("text", "UTF-8").alias("raw"), terms.alias("charset"), F.lit(True).alias("little_endian"))
    return E.decoded(rows).select("conv_id", "turn", F.md5(F.col("value").cast("binary")).alias("digest"))


_DUMMIES = "case vr " + " ".join(f"when '{k}' then '{v}'" for k, v in X.DUMMIES.items()) + " else '' end"


@_query(f"with {B.STUDIES_SQL} select object_id, tag, vr, case when substr(tag, 4, 1) = '9' then 'removed' else 'dummied' end as applied, case when substr(tag, 4, 1) = '9' then null else {_DUMMIES} end as value from e")
def deid_dummied(spark, sf):
    """Every attribute under a rule that replaces it: by a value of its representation, or by nothing where it has none."""
    rows = B.studies(spark, sf)
    rules = D.attributes(spark).select("tag", F.lit("D").alias("basic"), F.create_map().cast("map<string,string>").alias("options"))
    out, audit = X.deidentify(rows, actions=rules)
    left = out.where("tag not in ('00120062', '00120063')").select(F.col("object_id").alias("o"), F.col("ord").alias("n"), V.strip_pad(F.decode("raw", "ISO-8859-1")).alias("value"))
    return audit.join(left, (F.col("object_id") == F.col("o")) & (F.col("ord") == F.col("n")), "left").select("object_id", "tag", "vr", "applied", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
