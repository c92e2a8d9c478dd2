"""Replacement UIDs that are derived from the original alone, so equal UIDs stay equal in every file and run.

A digest's 256 bits as a decimal number have no built-in expression; they are turned in Arrow batches.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEFAULT_ROOT = "2.25"


def _remap(value: str, root: str) -> str:
    return f"{root}.{int.from_bytes(hashlib.sha256(value.encode()).digest())}"[:64]


@F.pandas_udf(StringType())
def digest_decimal(text: pd.Series) -> pd.Series:
    """The SHA-256 of a string as a decimal number."""
    return text.map(lambda x: None if x is None else str(int.from_bytes(hashlib.sha256(x.encode()).digest())))


def remap_uid(uid: Column, root: str = DEFAULT_ROOT) -> Column:
    """``root``, a dot, and as many digits of the digest's number as 64 characters leave, no leading zeros."""

    @F.pandas_udf(StringType())
    def one(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else _remap(x, root))

    return one(uid)


def remap_values(value: Column, root: str = DEFAULT_ROOT) -> Column:
    """Each value of a UI list remapped; trailing NULs and white space around a value do not count."""

    @F.pandas_udf(StringType())
    def every(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else "\\".join(_remap(u.strip(" "), root) for u in x.rstrip("\0").split("\\")))

    return every(value)


def uid_map(uids: DataFrame, column: str, root: str = DEFAULT_ROOT) -> DataFrame:
    """``(original, replacement)`` of the distinct UIDs of a column."""
    own = uids.select(F.trim(F.regexp_replace(F.col(column), r"\x00+\z", "")).alias("original")).where("original <> ''").distinct()
    return own.withColumn("replacement", remap_uid(F.col("original"), root))


def extend_map(known: DataFrame, uids: DataFrame, column: str, root: str = DEFAULT_ROOT) -> DataFrame:
    """``(original, replacement)`` of ``known``, which is kept as it is, and of the UIDs of a column that are not in it.

    So a map that is written after each run keeps every replacement ever given, those of a caller's own too. Of an original
    that ``known`` has more than once the smallest replacement counts; rows without one, or without an original, do not.
    """
    held = known.where("original is not null and replacement is not null").groupBy("original").agg(F.min("replacement").alias("replacement"))
    own = uids.select(F.trim(F.regexp_replace(F.col(column), r"\x00+\z", "")).alias("original")).where("original <> ''").distinct()
    new = own.join(held.select(F.col("original").alias("_o")), F.col("original") == F.col("_o"), "left_anti")
    return held.unionByName(new.withColumn("replacement", remap_uid(F.col("original"), root)))


def single_values(rows: DataFrame, keys: tuple[str, ...], column: str) -> DataFrame:
    """``(*keys, at, uid)``: the values of UI lists, as ``remap_values`` takes them apart."""
    text = F.regexp_replace(F.col(column), r"\x00+\z", "")
    return rows.where(F.col(column).isNotNull()).select(*keys, F.posexplode(F.split(text, r"\\")).alias("at", "uid")).withColumn("uid", F.trim("uid"))


def mapped_values(rows: DataFrame, keys: tuple[str, ...], column: str, table: DataFrame, root: str = DEFAULT_ROOT) -> DataFrame:
    """``(*keys, replaced)``: UI lists with each UID replaced by ``table(original, replacement)``, else by derivation."""
    given = table.select(F.col("original").alias("_original"), F.col("replacement").alias("_replacement"))
    met = single_values(rows, keys, column).join(given, F.col("uid") == F.col("_original"), "left")
    met = met.withColumn("new", F.coalesce("_replacement", remap_uid(F.when(F.col("_replacement").isNull(), F.col("uid")), root)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), "\\")
    return met.groupBy(*keys).agg(joined.alias("replaced"))
