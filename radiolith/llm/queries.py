"""The corpus operators as queries over the driver's tables: thin projections of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, jaccard_join, kd_means, language_id, mixing, preferences, secret_scan, simhash_dedup, suffix_dedup, token_records, vector_tree, warc_index


def vocabulary() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archive_pages(_table(spark, sf_dir, "pages"), 0)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.nearest(_table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, bits=2)


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_pairs(preferences.exchanged_replies(_table(spark, sf_dir, "conversations")))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents")).drop("finds")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=400)


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(_table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op13_kd_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_means.cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_index, op2_nearest, op3_language, op4_simhash, op5_preferences, op6_mix, op7_decontaminate, op8_secrets, op9_repeats, op10_records, op11_audit, op12_jaccard, op13_kd_means)}


OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as s from p),
r as (select *, min(page_id) over (partition by s) as first from d),
h as (select *, [cast(concat('0x', substr(s, i, 2)) as integer) for i in range(1, 40, 2)] as v from r)
select page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(((v[(k * 5) // 8 + 1] * 256 + coalesce(v[(k * 5) // 8 + 2], 0)) >> (11 - (k * 5) % 8)) & 31 as integer), 1) for k in range(0, 32)], '') as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first = page_id then null else first end as refers_to
from h
"""

OP6_SQL = r"""
with d as (select doc_id, source, md5(cast(doc_id as varchar)) as digest, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
w as (select *, case rank % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
r as (select *, 2 * source_size / weight as ratio, 1.5::double * sum(source_size) over () as goal,
  coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, rank rows between unbounded preceding and 1 preceding), 0) as held,
  sum(weight) over (order by 2 * source_size / weight, rank rows between current row and unbounded following) as open from w),
l as (select *, (goal - held) / open as level from r),
f as (select arg_min(level, ratio) as level, min(ratio) as ratio from l where ratio > level),
t as (select l.source, l.source_size, case when f.level is null then cast(2 * l.source_size as double) else least(cast(2 * l.source_size as double), l.weight * f.level) end as target from l cross join f),
o as (select d.*, t.source_size, t.target, coalesce(sum(size) over (partition by d.source order by digest rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast(greatest(0, least(before + size, round(target)) - before) + greatest(0, least(before + source_size + size, round(target)) - before - source_size) as bigint) as taken
from o
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1_SQL, "op5_preferences": preferences.ORACLE_SQL, "op6_mix": OP6_SQL, "op11_audit": filter_audit.oracle_sql(), "op13_kd_means": kd_means.oracle_sql()}


__all__ = ["F", "oracle_sql", "queries", "vocabulary"]
