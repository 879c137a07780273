"""Destinations: ordered rules per row, per-category thresholds, and rank-aware selection within bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _guards(category: Column, children: Column, appropriate: Column) -> Column:
    """The rules every item passes first; null flags never match."""
    return (
        F.when(category == "Ignore", "Ignore").when(children == F.lit(False), "Ignore")
        .when(appropriate == F.lit(False), "Review").when(category == "Review", "Review")
    )


def single(category: Column, score: Column, children: Column, appropriate: Column, share: Column | int = 4, review: Column | int = 3) -> Column:
    """Destination of a single item. Missing categories are Review, missing scores 2."""
    c, s = F.coalesce(category, F.lit("Review")), F.coalesce(score, F.lit(2))
    return F.coalesce(
        _guards(c, children, appropriate),
        F.when((c == "Share") & (s >= share), "Share").when(s >= review, "Review").otherwise("Storage"),
    )


def by_threshold(category: Column, score: Column, thresholds: dict[str, int], valid: list[str], default: str) -> Column:
    """Destination by a profile: unknown categories and scores below the category's threshold go to the default."""
    limits = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair]) if thresholds else F.expr("cast(map() as map<string,int>)")
    return by_profile(category, score, limits, F.array(*map(F.lit, valid)), F.lit(default))


def by_profile(category: Column, score: Column, thresholds: Column, valid: Column, default: Column) -> Column:
    """``by_threshold`` with the profile in columns: a map of thresholds (a category without one, or with null, takes any
    score), an array of categories, the default. A missing score is 2."""
    category = category.cast("string")
    known = F.coalesce(F.array_contains(valid, category), F.lit(False))
    least = F.try_element_at(thresholds, category)
    low = F.coalesce(F.coalesce(score, F.lit(2)) < least, F.lit(False))
    return F.when(~known | low, default).otherwise(category)


def burst(
    df: DataFrame, burst: str, index: str, category: str, score: str, rank: str, children: str, appropriate: str,
    share: int = 4, review: int = 3, consider: int = 2, vec: str | None = None, too_similar: float = 0.95,
) -> DataFrame:
    """``df`` with ``destination``: of each burst, members with a rank up to ``consider`` and a high score are shared
    unless they are as similar as ``too_similar`` to one shared before them (in index order); then, as the others, they
    are reviewed from ``review`` on, else stored. Missing ranks are the index + 1.

    Only members that could be shared compete: they are few per burst (``consider``, unless ranks repeat), and the
    selection is one fold over them in the JVM. Without ``vec``, or where a vector is missing or holds a NaN, all are different."""
    c, s = F.coalesce(category, F.lit("Review")), F.coalesce(score, F.lit(2))
    guard = _guards(c, F.col(children), F.col(appropriate))
    high = guard.isNull() & (F.coalesce(F.col(rank), F.col(index) + 1) <= consider) & (s >= share)
    rest = F.when(s >= review, "Review").otherwise("Storage")
    base = df.withColumn("__high", high).withColumn("__else", F.coalesce(guard, rest))
    if vec is None:
        return base.withColumn("destination", F.when(F.col("__high"), "Share").otherwise(F.col("__else"))).drop("__high", "__else")
    rivals = base.where("__high").groupBy(burst).agg(
        F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(vec).alias("v")))).alias("all")
    )
    dot = lambda a, b: F.nanvl(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x), F.lit(-1.0))
    taken = F.aggregate(
        "all", F.slice("all", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.coalesce(dot(x["v"], y["v"]) >= too_similar, F.lit(False))), acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    chosen = rivals.select(burst, F.explode(taken).alias("t")).select(burst, F.col("t.i").alias(index), F.lit(True).alias("__taken"))
    out = base.join(chosen, [burst, index], "left")
    share_ = F.col("__high") & F.coalesce("__taken", F.lit(False))
    return out.withColumn("destination", F.when(share_, "Share").otherwise(F.col("__else"))).drop("__high", "__else", "__taken")


def score_ranges(thresholds: dict[str, int], top: int = 5) -> list[tuple[str, int, int]]:
    """(category, lowest, highest score) from the thresholds, highest first; what is below all of them is open."""
    out, upper = [], top
    for name, low in sorted(thresholds.items(), key=lambda kv: (-kv[1], kv[0])):
        out.append((name, low, max(low, upper)))
        upper = low - 1
    return out
