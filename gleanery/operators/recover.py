"""Failed judgements and the cache: what to run again, what to clear, what to reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed(df: DataFrame, kinds: tuple[str, ...] = ("api_error", "invalid_response", "load_error")) -> DataFrame:
    """Rows that are error fallbacks of one of ``kinds``; none where the table has no such columns."""
    if not {"is_error_fallback", "error_type"} <= set(df.columns):
        return df.limit(0)
    return df.where(F.coalesce("is_error_fallback", F.lit(False)) & F.col("error_type").isin(*kinds))


def judged_in_error(df: DataFrame) -> DataFrame:
    """Rows whose is_error_fallback holds."""
    return df.where(F.coalesce("is_error_fallback", F.lit(False)))


def is_error(flag: Column | None, reasoning: Column) -> Column:
    """The flag, or, for reports without one, a reasoning that names a fallback."""
    named = F.coalesce(F.contains(reasoning, F.lit("Fallback response:")), F.lit(False))
    return named if flag is None else F.coalesce(flag, named)


def reprocess_plan(results: DataFrame, burst: str, item: str, failed_flag: str) -> DataFrame:
    """(unit, mode, items): singles with an error run alone; a burst whose members all failed runs whole; of other
    bursts only the failed members run, singly. The members stay rows of ``results``."""
    error = F.coalesce(F.col(failed_flag), F.lit(False))
    alone = F.col(burst).isNull() | (F.col(burst) == "")
    one = results.withColumn("unit", F.when(alone, F.concat(F.lit("item-"), F.col(item).cast("string"))).otherwise(F.col(burst)))
    plan = one.groupBy("unit", alone.alias("alone")).agg(
        F.count(F.lit(1)).alias("members"), F.count_if(error).alias("failures")
    ).where("failures > 0")
    mode = F.when(F.col("alone"), "single").when(F.col("members") == F.col("failures"), "whole").otherwise("members")
    return plan.select("unit", mode.alias("mode"), F.col("failures").alias("items"))


def clear_plan(results: DataFrame, burst: str, item: str, failed_flag: str) -> DataFrame:
    """(item, reason): items with an error, and all members of a burst in which one failed. A null or empty burst is none,
    as in CSV reports."""
    results = results.withColumn(burst, F.nullif(F.col(burst), F.lit("")))
    error = F.coalesce(F.col(failed_flag), F.lit(False))
    bad = results.where(error)
    hit = bad.where(F.col(burst).isNotNull()).select(burst).distinct()
    mates = results.join(hit, burst, "left_semi").select(item, F.when(error, "error").otherwise("burst").alias("reason"))
    single = bad.where(F.col(burst).isNull()).select(item, F.lit("error").alias("reason"))
    return mates.unionByName(single).groupBy(item).agg(F.max("reason").alias("reason"))


def burst_context(results: DataFrame, burst: str, item: str) -> DataFrame:
    """(burst, item, members): the members of every burst, for judging one of them again as part of it; items of null and
    empty bursts have no context. A burst stays rows, so one of any size is no problem."""
    rows = results.select(F.nullif(F.col(burst), F.lit("")).alias(burst), item).where(F.col(burst).isNotNull()).distinct()
    n = rows.groupBy(burst).agg(F.count(F.lit(1)).alias("members"))
    return rows.join(n, burst)


def with_context(failed_rows: DataFrame, context: DataFrame, burst: str) -> DataFrame:
    """``failed_rows`` with the number of members that its burst's context holds; 0 for singles and lost contexts."""
    known = context.groupBy(burst).agg(F.max("members").alias("members"))
    return failed_rows.join(known, burst, "left").na.fill(0, ["members"])


def summary(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row on a second judging: rows, those still in error, still in Review, and recovered (no error, not Review).
    before, after: key, destination, is_error_fallback; what is missing after is still in error."""
    both = before.select(key).join(after.select(key, "destination", "is_error_fallback"), key, "left")
    error = F.coalesce("is_error_fallback", F.lit(True))
    review = ~error & (F.coalesce("destination", F.lit("Review")) == "Review")
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(error).alias("still_error"), F.count_if(review).alias("still_review"),
        F.count_if(~error & ~review).alias("recovered"),
    )


def usable_entries(cache: DataFrame, as_of: Column, ttl_days: float, created: str = "created_at", reply: str = "reply") -> DataFrame:
    """Cache entries that may answer: not expired, and with a reply that can be read (corrupt ones are misses)."""
    from gleanery.functions.media import expired

    return cache.where(~expired(F.col(created), as_of, ttl_days) & F.col(reply).isNotNull())


def probe(keys: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): keys with their cached columns, and keys that must be computed."""
    return keys.join(cache, key), keys.join(cache.select(key), key, "left_anti")


def current_place(items: DataFrame, reviewed: DataFrame, present: DataFrame, path: str) -> DataFrame:
    """Where an item is now: its review copy, else its source if that still exists, else it is left out.
    reviewed: path, copy; present: path."""
    there = present.select(path, F.lit(True).alias("__there"))
    out = items.join(reviewed.select(path, "copy"), path, "left").join(there, path, "left")
    return out.withColumn("place", F.coalesce("copy", F.when(F.col("__there"), F.col(path)))).where("place is not null").drop("copy", "__there")
