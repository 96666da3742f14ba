"""The vector and text functions for SQL users, as temporary SQL functions (no Python involved)."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (signature, body)
FUNCTIONS = {
    "semtopics_trim": ("x STRING", "STRING", r"regexp_replace(x, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '')"),
    "semtopics_content_ratio": ("x STRING", "DOUBLE", r"CASE WHEN length(regexp_replace(x, '\\s', '')) = 0 THEN 0D ELSE length(regexp_replace(x, '[^\\p{L}]', '')) / length(regexp_replace(x, '\\s', '')) END"),
    "semtopics_tokens": ("x STRING", "ARRAY<STRING>", r"""regexp_extract_all(translate(lower(x), '’', "'"), "[\\p{L}\\p{N}]+(?:'[\\p{L}\\p{N}]+)*", 0)"""),
    "semtopics_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "semtopics_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "semtopics_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
