"""Counts, shares, tops and pages over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.operators.ordered import Ordered


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: the one with the largest version; combined before the shuffle. Null keys are dropped."""
    rows = df.where(F.col(key).isNotNull())
    packed = F.max_by(F.struct(*df.columns), F.struct(F.col(version))).alias("r")
    return rows.groupBy(key).agg(packed).select("r.*")


def counts(df: DataFrame, by: str, missing: str | None = None) -> DataFrame:
    """(by, n, percent): rows per value, largest share not rounded away; null values are ``missing`` if given."""
    value = F.coalesce(F.col(by), F.lit(missing)) if missing is not None else F.col(by)
    n = df.groupBy(value.alias(by)).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per value
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / total, 4))


def merge_counts(*parts: DataFrame, by: str) -> DataFrame:
    """The sums of several count tables (by, n)."""
    out = parts[0].select(by, "n")
    for p in parts[1:]:
        out = out.unionByName(p.select(by, "n"))
    return out.groupBy(by).agg(F.sum("n").alias("n"))


def top_scored(df: DataFrame, score: str, item: str, error: str, n: int = 5) -> DataFrame:
    """The n best rows by score, then item; rows without a score, with 0 and error fallbacks are out."""
    good = (F.coalesce(F.col(score), F.lit(0)) > 0) & ~F.coalesce(F.col(error), F.lit(False))
    return df.where(good).orderBy(F.desc(score), F.asc(item)).limit(n)


def shortened(text: Column, most: int = 60) -> Column:
    """Text of at most ``most`` characters, longer ones ending in '...'."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def evict(files: DataFrame, size: str, age: str, key: str, limit: int, keep: float = 0.9) -> DataFrame:
    """``files`` with ``evicted``: where all exceed ``limit`` bytes, the oldest go until ``keep`` of it is left. Ties in
    age go by key. The running total is taken by ranges of age."""
    total = files.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= limit:
        return files.withColumn("evicted", F.lit(False))
    rows = Ordered(files, [F.col(age), F.col(key)]).running_sum(F.col(size), "__sum").done()
    before = F.col("__sum") - F.coalesce(size, F.lit(0))
    return rows.withColumn("evicted", F.lit(total) - before > limit * keep).drop("__sum")


def cleanup(files: DataFrame, size: str, age: str, key: str, expired: Column, limit: int, keep: float = 0.9) -> DataFrame:
    """``files`` with ``fate``: expired first, then what ``evict`` takes of the rest, else kept."""
    late = F.coalesce(expired, F.lit(True))
    rest = evict(files.where(~late), size, age, key, limit, keep)
    rest = rest.withColumn("fate", F.when(F.col("evicted"), "evicted").otherwise("kept")).drop("evicted")
    return rest.unionByName(files.where(late).withColumn("fate", F.lit("expired")))


def sizes(files: DataFrame, store: str, size: str) -> DataFrame:
    """Bytes per store and, with a null store, of all."""
    return files.rollup(store).agg(F.sum(size).cast("long").alias("bytes"), F.count(F.lit(1)).alias("entries"))
