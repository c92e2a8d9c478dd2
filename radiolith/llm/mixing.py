"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame operations only.

Slot ``t`` of the mix takes the next block of the source in whose share of the unit interval the point
``frac((t + 1) / golden ratio)`` falls; after any number of slots each source has had its share to within a few
slots. A source's words, its documents in the order of the MD5 of their ids, are a stream that begins anew when
it ends; its ``r``-th slot takes block ``r`` of ``block`` words of it. Slots beyond a source's target are left
out, missing ones are appended, and the last block ends at the target.

Ranks within a source and running sizes are taken in two levels, first over groups of bounded size and
then over the groups' totals, so that no source has to pass through one task.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
GROUP = 4096
#: The golden ratio's fraction to 18 places: decimal products keep the point of a slot exact far beyond a double's 53 bits.
GOLDEN = Decimal("0.618033988749894848")
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, rank, source_size, target)``: one row a source of ``sizes(source, size)``.

    Sources are ranked by code point, null last, and take the weights in turn. Of ``share`` times all sizes each gets its
    part by weight; what exceeds ``most`` times a source's size is shared again by weight among the others,
    until none exceeds. The windows have one row a source.
    """
    per = materialize(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "mix-sources")
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sizes_of, per = per, materialize(per.withColumn("rank", rank).withColumn("weight", weight), "mix-ranked")
    discard(sizes_of)
    # with all ratios of limit to weight in order, the sources up to some place are held to their limits
    line = Window.orderBy("ratio", "rank")
    up_to = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("source_size") * most
    poured = per.withColumn("ratio", limit / F.col("weight")).withColumn("goal", F.sum("source_size").over(all_) * share)
    poured = poured.withColumn("held", F.sum(limit).over(up_to) - limit).withColumn("open", F.sum("weight").over(onward))
    poured = poured.withColumn("level", (F.col("goal") - F.col("held")) / F.col("open"))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(all_)
    poured = poured.withColumn("first", first)
    target = F.when(F.col("first").isNull(), limit.cast("double")).otherwise(F.least(limit.cast("double"), F.col("weight") * F.col("first.level")))
    return poured.select("source", F.col("rank").cast("int").alias("rank"), "source_size", target.alias("target"))


def _running(rows: DataFrame, key: str, order: str, size: str, groups: int, name: str) -> DataFrame:
    """Adds ``before``: the sum of ``size`` over the earlier rows of the same ``key`` in ``order``, a hexadecimal digest.

    Rows fall into ``groups`` groups a key by their digests' leading digits.
    """
    digits = max(1, math.ceil(math.log(max(groups, 2), 16)))
    rows = rows.withColumn("grp", F.substring(order, 1, digits))
    totals = materialize(rows.groupBy(key, "grp").agg(F.sum(size).alias("total")), name)
    line = Window.partitionBy(key).orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    totals = materialize(totals.select(F.col(key).alias("k"), F.col("grp").alias("g"), F.coalesce(F.sum("total").over(line), F.lit(0)).alias("base")), name + "-base")
    inner = Window.partitionBy(key, "grp").orderBy(order, "uid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    met = rows.join(totals, rows[key].eqNullSafe(totals["k"]) & (rows["grp"] == totals["g"]))
    return met.withColumn("before", F.col("base") + F.col("within")).drop("k", "g", "base", "within", "grp")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """``(rank, slot_no, slot, size)``: every slot of each source; ``slot`` is its place in the mix, null for appended ones."""
    spark = targets.sparkSession
    total = int(targets.agg(F.coalesce(F.sum(F.ceil(F.col("target") / block)), F.lit(0)).alias("n")).first()["n"])
    line = Window.orderBy("rank")
    edge = targets.where("target > 0").withColumn("hi", F.sum("target").over(line) / F.sum("target").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    edge = edge.withColumn("lo", F.coalesce(F.lag("hi").over(line), F.lit(0.0)))
    # an interval table of one row a source, cut at the cells of a fixed grid: slots meet it by cell, not by a theta join
    cells = 4096
    grid = edge.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("int"), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)).cast("int"))))
    grid = materialize(grid.select("rank", "lo", "hi", "cell"), "mix-grid")
    x = (F.col("id") + 1).cast("decimal(19,0)") * F.lit(GOLDEN)
    slots = spark.range(total).withColumn("u", (x - F.floor(x)).cast("double")).withColumn("cell", F.floor(F.col("u") * cells).cast("int"))
    slots = slots.join(grid, "cell").where("u >= lo and u < hi").select("rank", F.col("id").alias("slot"), F.floor(F.col("id") / GROUP).alias("grp"))
    slots = materialize(slots, "mix-slots")
    counts = materialize(slots.groupBy("rank", "grp").agg(F.count("*").alias("n")), "mix-counts")
    before = Window.partitionBy("rank").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(counts.select(F.col("rank").alias("r"), F.col("grp").alias("g"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "mix-base")
    within = F.row_number().over(Window.partitionBy("rank", "grp").orderBy("slot")) - 1
    ranked = slots.withColumn("within", within).join(base, (F.col("rank") == F.col("r")) & (F.col("grp") == F.col("g")))
    ranked = ranked.select("rank", (F.col("base") + F.col("within")).alias("slot_no"), "slot")
    goals = targets.where("target > 0").select(F.col("rank").alias("r"), F.round("target").cast("long").alias("goal"))
    have = materialize(counts.groupBy("rank").agg(F.sum("n").alias("n")), "mix-have")
    more = goals.join(have, F.col("rank") == F.col("r"), "left").withColumn("need", F.ceil(F.col("goal") / block)).where("need > coalesce(n, 0)")
    more = more.select(F.col("r").alias("rank"), F.explode(F.sequence(F.coalesce("n", F.lit(0)), F.col("need") - 1)).alias("slot_no"), F.lit(None).cast("long").alias("slot"))
    every = ranked.union(more).join(goals, F.col("rank") == F.col("r"))
    size = F.least(F.lit(block), F.col("goal") - F.col("slot_no") * block)
    every = materialize(every.select("rank", "slot_no", "slot", size.cast("long").alias("size")).where("size > 0"), "mix-schedule")
    discard(grid, slots, counts, base, have)
    return every


def mix(docs: DataFrame, block: int = 256, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as pieces ``(uid, doc_id, source, size, source_size, target, slot, slot_no, pass_no, start, length)``.

    A piece is words ``start`` to ``start + length`` of a document, the part of it in one slot; a document of which
    nothing is taken, or without words, has one row with nulls from ``slot`` on. ``uid`` tells rows with equal ids
    apart: equal rows in all of id, source and text are numbered. Null ids are allowed; a null text has no words. Other columns are not read. An empty table gives no rows.
    """
    if most < 1 or block < 1:
        raise ValueError("block and most must be 1 or more")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    sizes = own = materialize(own, "mix-sizes")
    same = Window.partitionBy("doc_id", "source", "th").orderBy("size")
    own = own.withColumn("uid", F.concat_ws(":", F.hex("th"), F.row_number().over(same).cast("string")))
    own = materialize(own.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.hex("th")))), "mix-docs")
    discard(sizes)
    targets = materialize(source_targets(own.select("source", "size"), weights, share, most), "mix-targets")
    n = own.count()
    placed = _running(own, "source", "digest", "size", -(-n // GROUP), "mix-running")
    placed = materialize(placed, "mix-placed")
    discard(own)
    t = targets.withColumnRenamed("source", "src")
    placed = placed.join(t, placed["source"].eqNullSafe(t["src"])).drop("src")
    goal = F.round("target").cast("long")
    # every time that a document passes by before its source's target, in slots
    passes = placed.where("size > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    passes = passes.withColumn("lo", F.col("before") + F.col("pass_no") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), goal)).where("hi > lo")
    cut = passes.withColumn("slot_no", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    cut = cut.withColumn("a", F.greatest(F.col("lo"), F.col("slot_no") * block)).withColumn("b", F.least(F.col("hi"), (F.col("slot_no") + 1) * block))
    plan = schedule(targets, block)
    slots = plan.select(F.col("rank").alias("r"), F.col("slot_no").alias("s"), "slot")
    cut = materialize(cut, "mix-cut")
    met = cut.join(slots, (cut["rank"] == slots["r"]) & (cut["slot_no"] == slots["s"]))
    pieces = met.select("uid", "doc_id", "source", "size", "source_size", "target", "slot", "slot_no", "pass_no", (F.col("a") - F.col("lo")).alias("start"), (F.col("b") - F.col("a")).alias("length"))
    pieces = materialize(pieces, "mix-pieces")
    discard(cut, plan)
    taken = pieces.select(F.col("uid").alias("u"), F.col("doc_id").alias("d"), F.col("source").alias("s")).distinct()
    rest = placed.join(taken, (placed["uid"] == taken["u"]) & placed["doc_id"].eqNullSafe(taken["d"]) & placed["source"].eqNullSafe(taken["s"]), "left_anti")
    null = F.lit(None)
    rest = rest.select("uid", "doc_id", "source", "size", "source_size", "target", null.cast("long").alias("slot"), null.cast("long").alias("slot_no"), null.cast("int").alias("pass_no"), null.cast("long").alias("start"), null.cast("long").alias("length"))
    return pieces.union(rest)


def mixed_sizes(docs: DataFrame, block: int = 256, **names) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of each row: the words that the mix takes of it, repeats counted."""
    pieces = mix(docs, block, **names)
    taken = F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("taken")
    return pieces.groupBy("doc_id", "source", "uid").agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), taken).select("doc_id", "size", "source_size", "target", "taken")
