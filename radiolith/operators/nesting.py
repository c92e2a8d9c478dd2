"""Sequences and their items as intervals of the element table, and as bytes again.

``ord`` is the order of reading: the rows of a sequence's items follow it, before the next element of its own data set. So a
sequence's rows are an interval of ``ord``, intervals are nested or apart, and what holds for all that is in some sequences is one running maximum
over the ends of their intervals. Bytes are put together without recursion: a row's bytes are its header and value, an item adds a
header before its first row, and the lengths in headers are sums over intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolith.functions import values as V

#: What rows must have to become bytes.
FIELDS = ("object_id", "path", "ord", "tag", "vr", "item_count", "full_span", "raw", "encoding")
ITEM, UNDEFINED = "FFFEE000", 0xFFFFFFFF


def depth(path: Column) -> Column:
    """How many sequences a row is within."""
    return F.length(path) - F.length(F.replace(path, F.lit("["), F.lit("")))


def sequence_key(path: Column, tag: Column) -> Column:
    """What the paths of a sequence's items begin with."""
    return F.when(path == "", tag).otherwise(F.concat(path, F.lit("/"), tag))


def item_paths(path: Column) -> Column:
    """The items that a row is in, outermost first."""
    steps = F.split(path, "/")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")))


def key_of_item(item: Column) -> Column:
    """The key of an item's sequence."""
    return F.regexp_replace(item, r"\[[0-9]+\]\z", "")


def number_of_item(item: Column) -> Column:
    return F.regexp_extract(item, r"\[([0-9]+)\]\z", 1).cast("int")


def intervals(elements: DataFrame) -> DataFrame:
    """Adds ``leave``: the last ``ord`` of what is in a sequence, or the row's own. Kept where it is there, as the parser gives it."""
    if "leave" in elements.columns:
        return elements
    inside = elements.where("path <> ''").select(F.col("object_id").alias("_o"), F.col("ord").alias("_ord"), F.explode(item_paths(F.col("path"))).alias("_item"))
    ends = inside.groupBy("_o", key_of_item(F.col("_item")).alias("_key")).agg(F.max("_ord").alias("_end"))
    own = (F.col("object_id") == F.col("_o")) & (sequence_key(F.col("path"), F.col("tag")) == F.col("_key")) & (F.col("vr") == "SQ")
    return elements.join(ends, own, "left").withColumn("leave", F.coalesce("_end", "ord")).drop("_o", "_key", "_end")


def inside(flag: Column) -> Column:
    """Whether a row is in a sequence, however far up, for which ``flag`` holds; of rows with ``leave``, in one sweep over each object."""
    before = Window.partitionBy("object_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce((F.max(F.when(flag, F.col("leave"))).over(before) >= F.col("ord")) & (F.col("path") != ""), F.lit(False))


def inherited(elements: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last ``value`` before a row in its data set, else the one at the sequence that it is in, else at that one's, to the root.

    Each data set asks the chain of its sequences at once: the nearest that knows answers. For a sequence without a row of its own the
    last value of its data set counts.
    """
    line = Window.partitionBy("object_id", "path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out = elements.withColumn("_value", value)
    out = out.withColumn("_own", F.last("_value", ignorenulls=True).over(line))
    sets = elements.where("path <> ''").select(F.col("object_id").alias("_so"), F.col("path").alias("_sp")).distinct()
    asked = sets.select("_so", "_sp", F.posexplode(item_paths(F.col("_sp"))).alias("_level", "_item")).withColumn("_ask", key_of_item(F.col("_item")))
    asked = asked.withColumn("_up", F.regexp_replace("_ask", r"/?[0-9A-F]{8}\z", ""))
    holds = out.select(F.col("object_id").alias("_ko"), sequence_key(F.col("path"), F.col("tag")).alias("_key"), F.struct("ord", F.col("_own").alias("known")).alias("_exact"))
    ends = out.groupBy(F.col("object_id").alias("_ko"), F.col("path").alias("_key")).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("ord"))).alias("_last")).where("_last is not null")
    exact = asked.join(holds, (F.col("_so") == F.col("_ko")) & (F.col("_ask") == F.col("_key"))).select("_so", "_sp", "_level", "_exact", F.lit(None).cast(dict(ends.dtypes)["_last"]).alias("_last"))
    rough = asked.join(ends, (F.col("_so") == F.col("_ko")) & (F.col("_up") == F.col("_key"))).select("_so", "_sp", "_level", F.lit(None).cast(dict(exact.dtypes)["_exact"]).alias("_exact"), "_last")
    found = exact.unionByName(rough).groupBy("_so", "_sp", "_level").agg(F.max("_exact").alias("_exact"), F.max("_last").alias("_last"))
    found = found.withColumn("_known", F.when(F.col("_exact").isNotNull(), F.col("_exact.known")).otherwise(F.col("_last"))).where("_known is not null")
    found = found.groupBy("_so", "_sp").agg(F.max_by("_known", "_level").alias("_above"))
    out = out.join(found, (F.col("object_id") == F.col("_so")) & (F.col("path") == F.col("_sp")), "left")
    return out.withColumn(name, F.coalesce("_own", "_above")).drop("_value", "_own", "_so", "_sp", "_above")


# bytes


def _turned(text: Column, width: int) -> Column:
    """Hexadecimal bytes in the other order."""
    return F.concat(*[F.substring(text, i, 2) for i in range(2 * width - 1, 0, -2)])


def number(n: Column, width: int, big: Column) -> Column:
    """A number as hexadecimal bytes."""
    text = F.lpad(F.hex(n), 2 * width, "0")
    return F.when(big, text).otherwise(_turned(text, width))


def _tag(tag: Column, big: Column) -> Column:
    return F.when(big, tag).otherwise(F.concat(_turned(F.substring(tag, 1, 4), 2), _turned(F.substring(tag, 5, 4), 2)))


def header(tag: Column, vr: Column, length: Column, encoding: Column) -> Column:
    """An element's header; null if a length of two bytes cannot say ``length``."""
    big = encoding == "explicit-be"
    code = F.hex(F.encode(vr, "ISO-8859-1"))
    long = F.concat(_tag(tag, big), code, F.lit("0000"), number(length, 4, big))
    short = F.when(length <= 0xFFFF, F.concat(_tag(tag, big), code, number(length, 2, big)))
    return F.unhex(F.when(encoding == "implicit-le", F.concat(_tag(tag, big), number(length, 4, big))).when(V.is_long_form(vr), long).otherwise(short))


def item_header(length: Column, encoding: Column) -> Column:
    big = encoding == "explicit-be"
    return F.unhex(F.concat(_tag(F.lit(ITEM), big), number(length, 4, big)))


def _header_size(vr: Column, encoding: Column) -> Column:
    return F.when((encoding != "implicit-le") & V.is_long_form(vr), 12).otherwise(8)


def _rebuilt() -> Column:
    """Sequences that are written from their items."""
    return (F.col("vr") == "SQ") & F.col("item_count").isNotNull()


def _verbatim() -> Column:
    """Elements whose ``raw`` is all of them, header included."""
    return F.col("full_span") & (F.length("raw") > 0)


def _written(elements: DataFrame) -> DataFrame:
    """The rows that are written, with ``raw`` even and never null, and the data set's encoding."""
    rows = elements.select(*[F.col(c) if c in elements.columns else F.lit(None).cast("boolean").alias(c) for c in FIELDS])
    rows = rows.where(F.substring("tag", 5, 4) != "0000")
    rows = rows.withColumn("full_span", F.coalesce("full_span", F.lit(False))).withColumn("raw", F.coalesce("raw", F.unhex(F.lit(""))))
    return rows.withColumn("encoding", F.when(F.col("encoding") == "deflated-le", "explicit-le").otherwise(F.col("encoding")))


def _lengths(rows: DataFrame) -> DataFrame:
    """``(object_id, key, length, items)`` of each sequence that is written from its items.

    ``items`` has a struct for each item in order: its number, its length, and after which row it begins.
    """
    value = F.length("raw")
    size = F.when(_rebuilt(), _header_size(F.col("vr"), F.col("encoding")) + 8 * F.col("item_count")).when(_verbatim(), value).otherwise(_header_size(F.col("vr"), F.col("encoding")) + value + value % 2)
    none = lambda kind: F.lit(None).cast(kind)
    at = lambda key, number, size, last, count, own: F.struct(key.alias("key"), number.alias("number"), size.cast("long").alias("size"), last.cast("long").alias("last"), count.alias("count"), own.cast("long").alias("own"))
    above = F.transform(item_paths(F.col("path")), lambda p: at(key_of_item(p), number_of_item(p), size, F.col("ord"), none("int"), none("long")))
    itself = F.when(_rebuilt(), F.array(at(sequence_key(F.col("path"), F.col("tag")), F.lit(-1), F.lit(0), none("long"), F.col("item_count"), F.col("ord"))))
    parts = rows.select("object_id", F.explode(F.concat(above, F.coalesce(itself, F.array().cast("array<struct<key:string,number:int,size:bigint,last:bigint,count:int,own:bigint>>")))).alias("p")).select("object_id", "p.*")
    items = parts.groupBy("object_id", "key", "number").agg(F.sum("size").alias("size"), F.max("last").alias("last"), F.max("count").alias("count"), F.max("own").alias("own"))
    whole = items.groupBy("object_id", "key").agg(F.max("count").alias("count"), F.max("own").alias("own"), F.map_from_entries(F.collect_list(F.when(F.col("number") >= 0, F.struct("number", F.struct("size", "last"))))).alias("held")).where("own is not null")
    some = F.coalesce("count", F.lit(0)) > 0
    numbers = F.when(some, F.sequence(F.lit(0), F.greatest(F.col("count"), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.struct(i.alias("number"), F.coalesce(F.element_at("held", i)["size"], F.lit(0).cast("long")).alias("size"), F.element_at("held", i)["last"].alias("last"))
    whole = whole.withColumn("listed", F.transform(numbers, one))
    # an item begins after the last row of the ones before it, or after the sequence's own row
    start = F.struct(F.array().cast("array<struct<number:int,size:bigint,after:bigint>>").alias("done"), F.col("own").alias("after"))
    placed = F.aggregate("listed", start, lambda acc, x: F.struct(F.concat(acc["done"], F.array(F.struct(x["number"].alias("number"), x["size"].alias("size"), acc["after"].alias("after")))).alias("done"), F.greatest(acc["after"], x["last"]).alias("after")), lambda acc: acc["done"])
    return whole.select("object_id", "key", F.aggregate("listed", F.lit(0).cast("long"), lambda a, x: a + x["size"] + 8).alias("length"), placed.alias("items"))


def pieces(elements: DataFrame, nested: bool = True) -> DataFrame:
    """``(object_id, path, after, turn, number, piece)``: the bytes of every object in parts; in the order of ``after``, ``turn`` and ``number`` they are its data set.

    ``piece`` is null for a value that its header cannot hold. ``path`` is that of the data set or, for an item's header, of the item's sequence with its number.
    Without ``nested`` only root elements are written, sequences as they are.
    """
    rows = _written(elements)
    if not nested:
        rows = rows.where("path = ''").withColumn("item_count", F.lit(None).cast("int"))
    plain = rows.where(~_rebuilt()).withColumn("even", V.pad_even(F.col("raw"), F.col("vr"))).withColumn("n", F.length("even"))
    own = F.when(_verbatim(), F.col("raw")).otherwise(F.concat(header(F.col("tag"), F.col("vr"), F.col("n"), F.col("encoding")), F.col("even")))
    plain = plain.select("object_id", "path", F.col("ord").cast("long").alias("after"), F.lit(0).alias("turn"), F.lit(0).alias("number"), own.alias("piece"))
    if not nested:
        return plain
    lengths = _lengths(rows).withColumnsRenamed({"object_id": "_o", "key": "_key"})
    sequences = rows.where(_rebuilt()).select("object_id", "path", "ord", "tag", "vr", "encoding", sequence_key(F.col("path"), F.col("tag")).alias("key"))
    sequences = sequences.join(lengths, (F.col("object_id") == F.col("_o")) & (F.col("key") == F.col("_key")))
    kind = "array<struct<path:string,after:bigint,turn:int,number:int,piece:binary>>"
    one = lambda path, after, turn, number, piece: F.struct(path.alias("path"), after.cast("long").alias("after"), turn.alias("turn"), number.alias("number"), piece.alias("piece"))
    head = F.array(one(F.col("path"), F.col("ord"), F.lit(0), F.lit(0), header(F.col("tag"), F.col("vr"), F.col("length"), F.col("encoding")))).cast(kind)
    # of headers after the same row those of inner sequences come first
    items = F.transform("items", lambda x: one(F.concat(F.col("key"), F.lit("["), x["number"].cast("string"), F.lit("]")), x["after"], 1000 - depth(F.col("key")), x["number"], item_header(x["size"], F.col("encoding")))).cast(kind)
    return plain.unionByName(sequences.select("object_id", F.explode(F.concat(head, items)).alias("p")).select("object_id", "p.*"))


JOINED = "listagg(piece, X'') within group (order by after, turn, number)"


def data_sets(elements: DataFrame, nested: bool = True) -> DataFrame:
    """``(object_id, body, broken)``: the bytes of each object's data set; ``broken`` if a value is too long for its header."""
    return pieces(elements, nested).groupBy("object_id").agg(F.expr(JOINED).alias("body"), F.bool_or(F.col("piece").isNull()).alias("broken"))


def rebuild(elements: DataFrame) -> DataFrame:
    """``elements`` with ``raw`` and ``length`` of every sequence written anew from the rows of its items, at any depth.

    ``raw`` is the content, items with their headers, without the sequence's own; ``full_span`` is then false. A value of
    an item that its header cannot hold makes ``raw`` null.
    """
    parts = pieces(elements)
    within = parts.where("path <> ''").select("object_id", "after", "turn", "number", "piece", F.explode(item_paths(F.col("path"))).alias("_item"))
    bodies = within.groupBy(F.col("object_id").alias("_o"), key_of_item(F.col("_item")).alias("_key")).agg(F.expr(JOINED).alias("_body"), F.bool_or(F.col("piece").isNull()).alias("_broken"))
    met = elements.join(bodies, (F.col("object_id") == F.col("_o")) & (sequence_key(F.col("path"), F.col("tag")) == F.col("_key")) & (F.col("vr") == "SQ"), "left")
    body = F.when(F.coalesce("_broken", F.lit(False)), None).otherwise(F.coalesce("_body", F.unhex(F.lit(""))))
    raw = F.when(_rebuilt(), body).otherwise(F.col("raw"))
    changed = {"raw": raw, "length": F.when(_rebuilt(), F.length(body).cast("long")).otherwise(F.col("length")) if "length" in elements.columns else None, "full_span": F.when(_rebuilt(), False).otherwise(F.col("full_span")) if "full_span" in elements.columns else None}
    return met.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(c) for c in elements.columns])
