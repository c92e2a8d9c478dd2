"""Functions of the library by name in SQL. They are SQL expressions, so the optimizer sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name, parameters, result, body; "\\\\" is one backslash in a SQL string
_FUNCTIONS = (
    ("is_valid_tag", "tag STRING", "BOOLEAN", r"tag RLIKE '^[0-9A-F]{8}\\z'"),
    ("is_private_tag", "tag STRING", "BOOLEAN", "substring(tag, 4, 1) IN ('1', '3', '5', '7', '9', 'B', 'D', 'F')"),
    ("join_tag", "grp INT, element INT", "STRING", "concat(lpad(hex(grp), 4, '0'), lpad(hex(element), 4, '0'))"),
    ("canonical_private_key", "tag STRING", "STRING", "concat(substring(tag, 1, 4), 'XX', substring(tag, 7, 2))"),
    ("strip_pad", "value STRING", "STRING", r"regexp_replace(value, '[ \\x00]+\\z', '')"),
    ("first_string", "value STRING", "STRING", r"nullif(trim(get(split(regexp_replace(value, '[ \\x00]+\\z', ''), '\\\\'), 0)), '')"),
    ("decimal_string", "token STRING", "DOUBLE", r"CASE WHEN token RLIKE '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z' AND abs(try_cast(token AS DOUBLE)) < double('Infinity') THEN try_cast(token AS DOUBLE) END"),
    ("integer_string", "token STRING", "BIGINT", r"CASE WHEN token RLIKE '^[+-]?[0-9]+\\z' THEN try_cast(token AS BIGINT) END"),
)


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for the session and returns their names."""
    for name, parameters, result, body in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in _FUNCTIONS]
