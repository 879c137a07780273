"""Problem 4: the N highest-scoring items within every group, with one order for ties.

Method: two-stage salted ranking. Each group is divided into subgroups by a hash of the item; every subgroup ranks and
keeps N; the survivors (N times the number of subgroups at most) are ranked by score and identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n(
    df: DataFrame, group: list[str], item: str, order: list[Column], n: int, subgroups: int = 64, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, then by ``item`` ascending, with their ``rank`` from 1.

    ``order`` says where nulls go. A null group is a group of its own, as in SQL; rows that are equal in order and
    item are interchangeable; an empty table gives an empty result; other columns pass through. Spark limits each
    subgroup before the shuffle, so a group with a third of all rows sends n rows per task and subgroup.
    """
    salt, r = "__subgroup", "__rank"
    by = [*order, F.col(item).asc_nulls_last()]
    first = Window.partitionBy(*group, salt).orderBy(*by)
    last = Window.partitionBy(*group).orderBy(*by)
    kept = df.withColumn(salt, F.pmod(F.xxhash64(item), F.lit(subgroups))).withColumn(r, F.row_number().over(first))
    kept = kept.where(F.col(r) <= n).drop(salt, r)
    return kept.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= n)


def latest_scores(results: DataFrame) -> DataFrame:
    """(burst_id, item_id, score, local_rank): each item of a burst once, by its judgement with the latest judged_at,
    then the largest result_id. Null judged_at counts as earliest; deliveries of one result_id, should they differ, go
    by the latest loaded_at. Items whose score is null drop out; scores are clamped to 1..5; rows without a burst or an
    item are left out. Copies are combined before the shuffle."""
    newest = F.max_by(F.struct("score", "local_rank"), F.struct("judged_at", "result_id", "loaded_at"))
    rows = results.where("burst_id is not null and item_id is not null")
    one = rows.groupBy("burst_id", "item_id").agg(newest.alias("j"))
    return one.where("j.score is not null").select(
        "burst_id", "item_id", F.least(F.greatest("j.score", F.lit(1)), F.lit(5)).alias("score"),
        F.col("j.local_rank").alias("local_rank"),
    )


def best_of_bursts(results: DataFrame, n: int) -> DataFrame:
    order = [F.col("score").desc_nulls_last(), F.col("local_rank").asc_nulls_last()]
    return top_n(latest_scores(results), ["burst_id"], "item_id", order, n)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/classification_results.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(burst_id, item_id): the first three items of every burst."""
    return best_of_bursts(_results(spark, sf_dir), 3).select("burst_id", "item_id")


def p4_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best items of every burst with score, rank and the folder that holds them."""
    best = best_of_bursts(_results(spark, sf_dir), 10)
    media = spark.read.parquet(f"{sf_dir}/media_items.parquet").select(
        "item_id", F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    )
    return best.join(media, "item_id", "left").select("burst_id", "item_id", "score", "rank", "folder")
