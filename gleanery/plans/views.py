"""SQL access: the tables of a folder and the derived ones as views, the scalar rules as SQL functions."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from gleanery.plans import queries

#: SQL bodies of the scalar rules; the argument is x.
FUNCTIONS = {
    "gl_extension": ("x STRING", "lower(regexp_extract(regexp_extract(x, '([^/]*)$', 1), '.[.]([^.]+)$', 1))"),
    "gl_folder": ("x STRING", "regexp_replace(x, '/[^/]*$', '')"),
    "gl_word_count": ("x STRING", "coalesce(size(filter(split(x, '\\\\s+'), w -> w <> '')), 0)"),
    "gl_clean_name": ("x STRING", "trim(regexp_replace(x, '[/\\\\\\\\:*?\"<>|]', ''))"),
    "gl_clamped": ("x DOUBLE", "CASE WHEN x IS NULL THEN NULL ELSE greatest(1, least(5, CAST(x AS INT))) END"),
}
DERIVED = {
    "gl_items": queries.items, "gl_sessions": queries.burst_sessions, "gl_judgements": lambda s, d: queries.judged(s, d, "item_id", "config_id", "burst_id"),
    "gl_routes": queries.route_single, "gl_comparisons": queries.comparisons, "gl_labels": queries.pairwise_labels,
}


def register(spark: SparkSession, sf_dir: str, tables: list[str]) -> list[str]:
    """Makes temporary views of the named tables and of the derived ones whose tables are there, and the functions."""
    for name, (argument, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument}) RETURN {body}")
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{PurePosixPath(name).name}.parquet").createOrReplaceTempView(name)
    for name, make in DERIVED.items():
        make(spark, sf_dir).createOrReplaceTempView(name)
    return [*tables, *DERIVED]
