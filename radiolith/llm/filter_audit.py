"""Audit of how document filters interact, from signed parity sums.

Each document has a mask of the filters that it fails. For every subset of the filters the documents of a part are summed with the
sign of the parity of their failures in it (a Walsh-Hadamard transform, one map-side aggregate of integers); inverted, the sums are the
numbers of documents with each mask, exactly. Every order of the filters is then read off these cells, whatever the number of documents,
and so is each filter's share over all orders: a document that fails ``m`` filters falls to each of them in one of ``m`` orders.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORDS = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
LABELS = ("all", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides: too few words, too few different ones, capitals, symbols."""
    words = F.array_remove(F.split(text, WORDS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct.cast("long") < 50 * n.cast("long"), "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def _first_of_text(rows: DataFrame) -> DataFrame:
    """Adds ``later``: whether a row with a smaller id has the same text (``digest``)."""
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("_id")).withColumnRenamed("digest", "_d")
    # joined by text and id together, so that the copies of one text are no hot key
    met = rows.join(least, (F.col("digest") == F.col("_d")) & (F.col("doc_id") == F.col("_id")), "left")
    return met.withColumn("later", F.col("_id").isNull() & F.col("doc_id").isNotNull()).drop("_d", "_id")


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, good, toxic)`` of each row of ``docs``; bit ``i`` of ``mask`` is failure ``i`` of ``FILTERS``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in text_failures(F.col("text")).items()]
    rows = rows.select("doc_id", "part", sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    rows = materialize(rows, "audit-rows")
    rows = _first_of_text(rows).select("doc_id", "part", (F.col("mask") + F.when(F.col("later"), 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))
    own = labels.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = rows.join(own, F.col("doc_id") == F.col("_id"), "left")
    return met.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def parity_sums(rows: DataFrame, width: int = len(FILTERS)) -> DataFrame:
    """``(part, label, w)``: for each subset of the filters the rows of a part and label, those with an odd number of its failures counted as minus one."""
    label = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")))).alias("label")
    sign = lambda s: F.lit(1).cast("long") - 2 * F.bit_count(F.col("mask").bitwiseAND(s)).bitwiseAND(1)
    sums = rows.select("part", "mask", label).groupBy("part", "label").agg(*[F.sum(sign(s)).alias(f"w{s}") for s in range(1 << width)])
    return sums.select("part", "label", F.array(*[f"w{s}" for s in range(1 << width)]).alias("w"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def cells(w: Column, width: int = len(FILTERS)) -> Column:
    """The inverse: how many rows have each mask. The transform is its own inverse but for a factor of ``2 ** width``, so that nothing remains."""
    odd = lambda m, s: F.bit_count(m.bitwiseAND(s)).bitwiseAND(1) == 1
    return F.transform(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.shiftright(_sum(F.transform(w, lambda x, s: F.when(odd(m, s), -x).otherwise(x))), width))


def orders(filters: str = FILTERS) -> list[str]:
    """Every order of the filters."""
    return ["".join(o) for o in itertools.permutations(filters)]


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` for each part, order and step.

    A part is a value of ``part_col``, null and the empty string being one. Null texts are empty. A row fails E if a row with a smaller id has the
    same text, told by SHA-256; a null id is smaller than none, and no id than it. Rows that repeat count each; repeated rows
    of ``labels`` are one document that has a label if any of them has. Other columns are not read. An empty table gives no rows.
    """
    sums = parity_sums(masks(docs, labels, id_col, text_col, part_col))
    held = sums.groupBy("part").pivot("label", list(LABELS)).agg(F.first("w"))
    none = F.array_repeat(F.lit(0).cast("long"), 1 << len(FILTERS))
    held = materialize(held.select("part", *[cells(F.coalesce(c, none)).alias(c) for c in LABELS]), "audit-cells")
    bit = {f: 1 << FILTERS.index(f) for f in filters}
    steps = [(o, i + 1, bit[f], sum(bit[g] for g in o[:i])) for o in orders(filters) for i, f in enumerate(o)]
    return held.select("part", F.explode(_steps(steps)).alias("s"), *LABELS).select("part", F.col("s.filter_order").alias("filter_order"), F.col("s.step").alias("step"), *_counts(F.col("s.own"), F.col("s.before"), len(filters)))


def _steps(steps: Sequence[tuple[str, int, int, int]]) -> Column:
    kind = "array<struct<filter_order:string,step:int,own:int,before:int>>"
    return F.from_json(F.lit("[" + ",".join('{"filter_order":"%s","step":%d,"own":%d,"before":%d}' % s for s in steps) + "]"), kind)


def _counts(own: Column, before: Column, n: int) -> list[Column]:
    hits = lambda m, bits: m.bitwiseAND(bits) != 0

    def total(cells: Column, counts) -> Column:
        """The sum of the cells, each times what ``counts`` gives for its mask."""
        return _sum(F.transform(cells, lambda x, m: F.when(counts(m), x).otherwise(F.lit(0).cast("long"))))

    removed = lambda m: hits(m, own) & ~hits(m, before)
    share = lambda m: F.element_at(F.array(*[F.lit(math.factorial(n) // max(1, i)).cast("long") for i in range(n + 1)]), F.bit_count(m).cast("int") + 1)
    shapley = _sum(F.transform("all", lambda x, m: F.when(hits(m, own), x * share(m)).otherwise(F.lit(0).cast("long"))))
    return [
        total(F.col("all"), lambda m: ~hits(m, own) & ~hits(m, before)).alias("kept"), total(F.col("all"), removed).alias("removed"), total(F.col("all"), lambda m: hits(m, own) & hits(m, before)).alias("redundant"),
        total(F.col("all"), lambda m: m == own).alias("unique_fails"), total(F.col("good"), removed).alias("good_lost"), total(F.col("toxic"), removed).alias("toxic_lost"), shapley.alias("shapley"),
    ]


def oracle_sql() -> str:
    """The same in SQL over ``documents`` and ``labels``, by counting documents with each mask."""
    listed = ", ".join(f"'{o}'" for o in orders())
    fails = lambda f: f"((mask >> {FILTERS.index(f)}) & 1)"
    own = "((mask >> (strpos('ABCDE', substr(o, step, 1)) - 1)) & 1) = 1"
    before = "(" + " + ".join(f"case when strpos(substr(o, 1, step - 1), '{f}') > 0 then {fails(f)} else 0 end" for f in FILTERS) + ") > 0"
    return rf"""with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select doc_id, part, case when len(w) < 200 then 1 else 0 end as a, case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end as b,
  case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) then 4 else 0 end as c, case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end as d,
  case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end as e from t),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
m as (select part, a + b + c + d + e as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from f left join l using (doc_id)),
g as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic, {" + ".join(fails(f) for f in FILTERS)} as fails from m group by part, mask),
s as (select o, step from (select unnest([{listed}]) as o) cross join (select unnest([1, 2, 3, 4, 5]) as step))
select part, o as filter_order, cast(step as integer) as step,
  cast(sum(case when not ({own}) and not ({before}) then n else 0 end) as bigint) as kept, cast(sum(case when {own} and not ({before}) then n else 0 end) as bigint) as removed,
  cast(sum(case when {own} and {before} then n else 0 end) as bigint) as redundant, cast(sum(case when {own} and fails = 1 then n else 0 end) as bigint) as unique_fails,
  cast(sum(case when {own} and not ({before}) then good else 0 end) as bigint) as good_lost, cast(sum(case when {own} and not ({before}) then toxic else 0 end) as bigint) as toxic_lost,
  cast(sum(case when {own} then n * (120 // greatest(1, fails)) else 0 end) as bigint) as shapley
from g cross join s group by part, o, step"""
