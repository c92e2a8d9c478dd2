"""The driver's relational tables as element tables, so that the library's operators have an oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolith.operators.elements import decoded
from radiolith.sources import writer


#: Tasks for the rows of a split of the scan, 128 MB of line items at most; a row becomes eight wider ones.
TASKS_A_SPLIT = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _two_bytes(value, big):
    """A US value."""
    number = F.lpad(F.hex(value.try_cast("int")), 4, "0")
    return F.unhex(F.substring(F.repeat(number, 2), F.when(big, 1).otherwise(3), F.lit(4)))


def _rows(base: DataFrame, object_id, fields: list[tuple[str, str, object]]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("tag"), F.lit(v).alias("vr"), c.cast("string").alias("value")) for i, (t, v, c) in enumerate(fields)])
    rows = base.select(object_id.cast("string").alias("object_id"), F.explode(parts).alias("e")).select("object_id", F.lit("").alias("path"), "e.*")
    rows = rows.withColumn("raw", F.when(F.col("vr") == "US", _two_bytes(F.col("value"), F.lit(False))).otherwise(F.encode("value", "UTF-8")))
    rows = decoded(rows.drop("value").withColumn("little_endian", F.lit(True)), "utf-8").drop("little_endian")
    return rows.withColumn("item_count", F.lit(None).cast("int")).withColumn("length", F.length("raw").cast("bigint")).withColumn("byte_offset", F.col("ord").cast("bigint") * 100)


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object an order: patient and study attributes, and a private block."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows at any scale
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    base = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return _rows(base, F.col("o_orderkey"), [
        ("00080020", "DA", F.date_format("o_orderdate", "yyyyMMdd")), ("00080030", "TM", F.date_format("o_orderdate", "HHmmss")), ("00080050", "SH", F.col("o_orderkey")), ("00081030", "LO", F.col("o_orderpriority")),
        ("00090010", "LO", F.lit("ACME 1.0")), ("00091001", "LO", F.col("o_orderstatus")), ("00100010", "PN", F.replace("c_name", F.lit("#"), F.lit("^"))), ("00100020", "LO", F.col("c_custkey")), ("00100021", "LO", F.col("n_name")),
        ("00100040", "CS", F.col("c_mktsegment")), ("0020000D", "UI", F.concat(F.lit("1.2.840."), F.col("o_orderkey").cast("string"))),
    ])


STUDIES_SQL = """b as (select cast(o_orderkey as varchar) as object_id, * from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
e as (select object_id, x.ord as ord, x.tag as tag, x.vr as vr, x.value as value from (select object_id, unnest([
  {'ord': 0, 'tag': '00080020', 'vr': 'DA', 'value': strftime(o_orderdate, '%Y%m%d')}, {'ord': 1, 'tag': '00080030', 'vr': 'TM', 'value': strftime(o_orderdate, '%H%M%S')}, {'ord': 2, 'tag': '00080050', 'vr': 'SH', 'value': cast(o_orderkey as varchar)},
  {'ord': 3, 'tag': '00081030', 'vr': 'LO', 'value': o_orderpriority}, {'ord': 4, 'tag': '00090010', 'vr': 'LO', 'value': 'ACME 1.0'}, {'ord': 5, 'tag': '00091001', 'vr': 'LO', 'value': o_orderstatus},
  {'ord': 6, 'tag': '00100010', 'vr': 'PN', 'value': replace(c_name, '#', '^')}, {'ord': 7, 'tag': '00100020', 'vr': 'LO', 'value': cast(c_custkey as varchar)}, {'ord': 8, 'tag': '00100021', 'vr': 'LO', 'value': n_name},
  {'ord': 9, 'tag': '00100040', 'vr': 'CS', 'value': c_mktsegment}, {'ord': 10, 'tag': '0020000D', 'vr': 'UI', 'value': concat('1.2.840.', o_orderkey)}]) as x from b))"""


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, str, object]]]:
    """One row an object, and its attributes as columns of it."""
    lines = table(spark, sf_dir, "lineitem").withColumn("object_id", F.concat_ws(".", "l_orderkey", "l_linenumber"))
    # an object's rows meet once, in as many tasks as the input calls for: what groups by object after this needs no further shuffle
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_SPLIT * lines.rdd.getNumPartitions())
    base = lines.repartition(tasks, "object_id").groupBy("object_id", "l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("p"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"))
    price = F.col("p").cast("decimal(18,2)").cast("string")
    return base, [
        ("00080018", "UI", F.concat(F.lit("1.2.840.1."), F.concat_ws(".", "l_orderkey", "l_linenumber"))), ("00080060", "CS", F.col("f")), ("0020000E", "UI", F.concat(F.lit("1.2.840.2."), F.col("l_orderkey").cast("string"))), ("00200011", "IS", F.col("l_linenumber")),
        ("00280010", "US", F.col("q").cast("int")), ("00280103", "US", F.when(F.col("s") == "O", F.lit("0")).when(F.col("f") == "R", F.lit("1")).otherwise(F.lit("2"))), ("00281050", "DS", F.concat(price, F.lit("\\bad\\"), F.col("q").cast("int").cast("string"))), ("00281053", "DS", price),
    ]


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object for each order of the line items' first rows by number: series and image attributes."""
    base, fields = _images(spark, sf_dir)
    return _rows(base, F.col("object_id"), fields)


def image_files(spark: SparkSession, sf_dir: str, syntaxes: tuple[str, ...]) -> DataFrame:
    """``(path, content)``: the objects of :func:`images` as Part 10 files, written from columns, each in one of ``syntaxes`` by its id."""
    base, fields = _images(spark, sf_dir)
    # with the syntax first, as the bytes of numbers follow from it
    base = base.withColumn("_uid", syntax_of(syntaxes))
    big = F.col("_uid") == "1.2.840.10008.1.2.2"

    def raw(vr: str, value):
        text = value.cast("string")
        return _two_bytes(text, big) if vr == "US" else F.encode(text, "UTF-8")

    files = writer.serialize_columns(base, [(t, v, raw(v, c)) for t, v, c in fields], F.col("_uid"), tuple(syntaxes))
    return files.withColumnRenamed("object_id", "path")


IMAGES_SQL = r"""b as (select l_orderkey, l_linenumber, min(l_quantity) as q, min(l_extendedprice) as p, min(l_returnflag) as f, min(l_linestatus) as s from lineitem group by all),
w as (select concat(l_orderkey, '.', l_linenumber) as object_id, concat('1.2.840.1.', l_orderkey, '.', l_linenumber) as sop, f as modality, concat('1.2.840.2.', l_orderkey) as series, cast(l_linenumber as double) as number, cast(q as integer) as q,
  case when s = 'O' then 0 when f = 'R' then 1 else 2 end as pr, cast(cast(p as decimal(18,2)) as varchar) as price from b)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a content sequence: item = turn, with a code and a text in each item."""
    conv = table(spark, sf_dir, "conversations")
    step = F.concat(F.lit("0040A730["), F.col("turn").cast("string"), F.lit("]"))
    oid = F.col("conv_id").cast("string")
    cells = F.array(F.struct(step.alias("path"), (F.col("turn") * 10 + 1).alias("ord"), F.lit("0040A160").alias("tag"), F.lit("UT").alias("vr"), F.col("text").alias("value"), F.lit(None).cast("int").alias("item_count")), F.struct(step.alias("path"), (F.col("turn") * 10 + 2).alias("ord"), F.lit("0040A043").alias("tag"), F.lit("SQ").alias("vr"), F.lit("").alias("value"), F.when(F.col("turn") % 5 != 4, 1).alias("item_count")), F.struct(F.concat(step, F.lit("/0040A043[0]")).alias("path"), (F.col("turn") * 10 + 3).alias("ord"), F.lit("00080104").alias("tag"), F.lit("LO").alias("vr"), F.col("role").alias("value"), F.lit(None).cast("int").alias("item_count")))
    inner = conv.select(oid.alias("object_id"), F.explode(cells).alias("e")).select("object_id", "e.*")
    outer = conv.groupBy(oid.alias("object_id")).agg(F.count("*").cast("int").alias("item_count")).select("object_id", F.lit("").alias("path"), F.lit(0).cast("bigint").alias("ord"), F.lit("0040A730").alias("tag"), F.lit("SQ").alias("vr"), F.lit("").alias("value"), "item_count")
    return inner.withColumn("ord", F.col("ord").cast("bigint")).unionByName(outer).withColumn("raw", F.encode("value", "UTF-8"))


def syntax_of(uids):
    """One of ``uids`` for each object."""
    return F.element_at(F.array(*[F.lit(u) for u in uids]), (F.pmod(F.xxhash64("object_id"), F.lit(len(uids))) + 1).cast("int"))


def part10(rows: DataFrame, syntax) -> DataFrame:
    """``(path, content)``: the objects of ``rows`` as Part 10 files, each in the transfer syntax that ``syntax`` gives for its id."""
    turned = F.unhex(F.concat(F.substring(F.hex("raw"), 3, 2), F.substring(F.hex("raw"), 1, 2)))
    big = F.element_at("meta", "transfer_syntax_uid") == "1.2.840.10008.1.2.2"
    meta = F.create_map(F.lit("transfer_syntax_uid"), syntax)
    files = rows.select("object_id").distinct().select("object_id", meta.alias("meta"), F.array().cast("array<struct<tag:string,vr:string,value:binary>>").alias("residue"))
    own = rows.withColumn("meta", meta).withColumn("raw", F.when(big & (F.col("vr") == "US"), turned).otherwise(F.coalesce("raw", F.unhex(F.lit(""))))).withColumn("full_span", F.lit(False))
    return writer.serialize(files, own, False).select(F.col("object_id").alias("path"), "content")
