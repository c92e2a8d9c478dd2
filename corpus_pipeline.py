"""A training corpus from ``documents`` in five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolith.llm import decontaminate, language_id, mixing, simhash_dedup, token_records
from radiolith.llm.common import materialize, shuffle_width
from radiolith.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the language found by the text, whatever the id. Documents without one go: null texts and texts without a letter."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source", "n_chars")
    model = language_id.learn(language_id.learnable(docs))
    return language_id.relabel(docs, model).where("lang <> 'und'")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays, the one with the smallest doc_id (nulls last); of rows with one id, that with the smallest text hash, source (nulls last), lang and n_chars.

    Copies are equal texts, and texts of which the five-word shingles are alike to 0.8 or more. Null and wordless texts are copies of their
    equals alone. Rows that repeat are copies. An empty table gives no rows.
    """
    like = materialize(simhash_dedup.similar_components(docs, shingle=5, similarity=0.8), "pipeline-like").withColumnRenamed("th", "member")
    out = _ids(docs).withColumn("th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    own = ("doc_id", "th", "source", "lang", "n_chars")
    named = out.select(*own).join(like, F.col("th") == F.col("member"), "left").select(*own, F.coalesce("root", "th").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", F.col("source").isNull().alias("unsourced"), *own[2:])
    first = named.groupBy("root").agg(F.min(order).alias("f"))
    first = materialize(first.select(*[F.col(f"f.{c}").alias(f"kept_{c}") for c in own]), "pipeline-first")
    same = (F.col("th") == F.col("kept_th")) & out["doc_id"].eqNullSafe(first["kept_doc_id"])
    for c in own[2:]:
        same = same & out[c].eqNullSafe(first[f"kept_{c}"])
    return out.join(first, same, "left_semi").dropDuplicates(["doc_id", "th"]).drop("th")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: by their texts, whatever their ids. Null texts hold none; repeated rows go or stay together; an empty table gives no rows."""
    out = _ids(docs).withColumn("th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    found = decontaminate.find_passages(out, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="th").select(F.col("doc_id").alias("gone")).distinct()
    found = materialize(found, "pipeline-found")
    return out.join(found, out["th"] == found["gone"], "left_anti").drop("th")


def _row_key(th: Column) -> Column:
    """One string for a row's id, text hash and source, nulls told apart from all values."""
    return F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), th, F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit("")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that a source's target cuts ends there, words joined by spaces.

    Pieces go back to their rows by id, text and source, and by number among rows equal in all three; null ids and repeated ids are rows like others.
    """
    docs = docs.select(*COLUMNS)
    pieces = mixing.mix(docs).where("length is not null").groupBy("uid", "doc_id", "source", "pass_no", "size").agg(F.sum("length").alias("taken"))
    number = F.substring_index("uid", ":", -1).cast("int")
    pieces = materialize(pieces.select(_row_key(F.substring_index("uid", ":", 1)).alias("id"), number.alias("number"), "size", "taken"), "pipeline-mix")
    # one shuffle of the texts serves the numbering and the join
    rows = docs.withColumn("key", _row_key(F.hex(F.xxhash64(F.col("text").cast("string"))))).repartition(shuffle_width(spark), "key")
    rows = rows.withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy("lang", "n_chars")))
    met = rows.join(pieces, (rows["key"] == pieces["id"]) & (F.col("no") - F.col("number") == 0))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), 1), 1, F.col("taken").cast("int")), " ")
    text = F.when(F.col("taken") < F.col("size"), cut).otherwise(F.col("text"))
    return met.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary token records, as read back from their files: a row a document, repeated rows and null ids included. Null texts are empty; an empty table gives no rows."""
    return token_records.token_records(docs, vocabulary(), end_id=1)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again. Other columns than those of ``documents`` are not read; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
