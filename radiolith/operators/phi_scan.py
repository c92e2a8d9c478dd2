"""Identity in free text: dates and caret-joined names, less an allow-list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolith.functions import values as V

ISO_DATE = r"(?<![0-9])((?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))(?![0-9])"
COMPACT_DATE = r"(?<![0-9.])((?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))(?![0-9.])"
NAME = r"(?<![A-Za-z^])([A-Z][A-Za-z'-]+\^[A-Z][A-Za-z'^-]*)"
YEARS = 120


def scan_text(texts: DataFrame, key: str, text: str, this_year: int, allowed: DataFrame | None = None) -> DataFrame:
    """``(key, recognizer, token)`` of every find; dates of ``this_year - 120`` and later; allowed tokens go."""

    def found(recognizer: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda t: F.struct(F.lit(recognizer).alias("recognizer"), t.alias("token")))

    finds = F.concat(found("iso_date", ISO_DATE), found("compact_date", COMPACT_DATE), found("name", NAME))
    rows = texts.select(key, F.explode(finds).alias("f")).select(key, "f.recognizer", "f.token")
    rows = rows.where((F.col("recognizer") == "name") | (F.substring("token", 1, 4).try_cast("int") >= this_year - YEARS))
    if allowed is not None:
        rows = rows.join(allowed.select(F.col("token").alias("_t")).distinct(), F.col("token") == F.col("_t"), "left_anti")
    return rows


# The tags that hold names, dates and date-times of persons.
PN_TAGS = ("00080090", "00081048", "00081050", "00081060", "00081070", "00100010", "00101001", "00101005", "00101060", "0040A123")
DA_TAGS = ("00080020", "00080021", "00080022", "00080023", "00100030", "0040A030")
DT_TAGS = ("0008002A", "0040A12C", "0040A13A")


def scan_elements(elements: DataFrame, allowed: DataFrame | None = None, this_year: int | None = None) -> DataFrame:
    """``(object_id, tag, recognizer)`` of elements of identifying tags that hold something.

    ``allowed(kind, value)`` takes finds out: a ``name`` by its whole value, a ``name_prefix`` by how it begins, a ``date`` by its first
    eight digits. With ``this_year`` a date counts only if it has eight digits to begin with, of that year less 120 or later. Padding at the
    end does not count. Names are met by equality alone, prefixes by those lengths that the list has.
    """
    kind = F.when(F.col("tag").isin(*PN_TAGS), "name").when(F.col("tag").isin(*DA_TAGS, *DT_TAGS), "date")
    rows = elements.where(F.trim("value") != "").select("object_id", "tag", kind.alias("recognizer"), V.strip_pad(F.col("value")).alias("_value")).where("recognizer is not null")
    day = F.substring("_value", 1, 8)
    rows = rows.withColumn("_day", F.when((F.col("recognizer") == "date") & (F.col("tag").isin(*DT_TAGS) | (F.length("_value") == 8)) & day.rlike(r"^[0-9]{8}\z"), day))
    if this_year is not None:
        rows = rows.where((F.col("recognizer") == "name") | (F.substring("_day", 1, 4).try_cast("int") >= this_year - YEARS))
    if allowed is not None:
        listed = allowed.select(F.col("kind").alias("_kind"), F.col("value").alias("_allowed")).where("_allowed is not null").distinct()
        rows = rows.join(listed.where("_kind = 'name'"), (F.col("recognizer") == "name") & (F.col("_value") == F.col("_allowed")), "left_anti")
        rows = rows.join(listed.where("_kind = 'date'"), F.col("_day") == F.col("_allowed"), "left_anti")
        prefixes = listed.where("_kind = 'name_prefix'")
        for r in prefixes.select(F.length("_allowed").alias("n")).distinct().orderBy("n").collect():  # a row a length of a name
            own = prefixes.where(F.length("_allowed") == r["n"])
            rows = rows.join(own, (F.col("recognizer") == "name") & (F.substring("_value", 1, r["n"]) == F.col("_allowed")), "left_anti")
    return rows.select("object_id", "tag", "recognizer")


BASE64_RUN = r"([A-Za-z0-9+/]{16,})"


def base64_objects(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(path, content)`` of the Part 10 objects that stand in texts as base64, ready for the parser; ``path`` is the key and a number.

    An object has its preamble, or begins with the file meta group. What decodes to anything else is passed over, and
    nothing is looked for within an object.
    """
    runs = texts.select(F.col(key).cast("string").alias("_k"), F.posexplode(F.regexp_extract_all(text, F.lit(BASE64_RUN), 1)).alias("_n", "_run"))
    digits = F.length("_run") - F.when(F.length("_run") % 4 == 1, 1).otherwise(0)
    whole = F.rpad(F.substring("_run", F.lit(1), digits), F.ceil(digits / 4).cast("int") * 4, F.lit("="))
    runs = runs.select(F.concat_ws("#", "_k", "_n").alias("path"), whole.alias("_whole"))
    # what tells an object is read from the digits of its places: bytes 126 to 131, and 0 to 8
    mark = F.substring(F.unbase64(F.substring("_whole", 169, 8)), 3, 4)
    group = F.substring(F.unbase64(F.substring("_whole", 1, 12)), 1, 8)
    return runs.where((mark == F.lit(b"DICM")) | (group == F.lit(b"\x02\0\0\0UL\x04\0"))).select("path", F.unbase64("_whole").alias("content"))
