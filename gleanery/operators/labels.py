"""Labels from comparisons, their balance, sessions and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.operators.ordered import Ordered


def clean_choice(choice: Column) -> Column:
    """left, right, both or neither; null for anything else."""
    c = F.lower(F.trim(choice))
    return F.when(c.isin("left", "right", "both", "neither"), c)


def labels(pairs: DataFrame, first: str, second: str, choice: str) -> DataFrame:
    """(item, side, confidence) from comparisons with a clean choice: winners share at .95, losers store at .85, both
    share and neither store at .9. Per item the largest confidence of each side counts, and sharing wins a tie."""
    c, a, b = F.col(choice), F.col(first), F.col(second)
    entry = lambda item, side, conf: F.struct(item.alias("item"), F.lit(side).alias("side"), F.lit(conf).alias("conf"))
    votes = (
        F.when(c == "left", F.array(entry(a, "share", 0.95), entry(b, "storage", 0.85)))
        .when(c == "right", F.array(entry(b, "share", 0.95), entry(a, "storage", 0.85)))
        .when(c == "both", F.array(entry(a, "share", 0.9), entry(b, "share", 0.9)))
        .when(c == "neither", F.array(entry(a, "storage", 0.9), entry(b, "storage", 0.9)))
    )
    long = pairs.select(F.explode(votes).alias("v")).select("v.*").where("item is not null")
    return resolve(long)


def gallery_labels(galleries: DataFrame, photos: str, selected: str) -> DataFrame:
    """(item, side, confidence) from galleries: selected positions share at .95, the others store at .85."""
    long = galleries.select(F.posexplode(photos).alias("at", "item"), F.col(selected).alias("s"))
    picked = F.coalesce(F.array_contains("s", F.col("at")), F.lit(False))
    long = long.select(
        "item", F.when(picked, "share").otherwise("storage").alias("side"), F.when(picked, 0.95).otherwise(0.85).alias("conf")
    )
    return resolve(long.where("item is not null"))


def resolve(votes: DataFrame) -> DataFrame:
    """One side per item from (item, side, conf)."""
    best = votes.groupBy("item").agg(
        F.max(F.when(F.col("side") == "share", F.col("conf"))).alias("s"),
        F.max(F.when(F.col("side") == "storage", F.col("conf"))).alias("t"),
    )
    share = F.col("s").isNotNull() & (F.col("t").isNull() | (F.col("s") >= F.col("t")))
    return best.select(
        "item", F.when(share, "share").otherwise("storage").alias("side"), F.when(share, F.col("s")).otherwise(F.col("t")).alias("confidence")
    )


def balanced(labelled: DataFrame, ratio: int = 3) -> DataFrame:
    """All shared items and at most ``ratio`` times as many stored ones, those of the highest confidence, ties by item.
    Nothing is cut where nothing is shared. The cut is a global rank by ranges."""
    shared = labelled.where("side = 'share'").count()
    if not shared:
        return labelled
    ranked = Ordered(labelled.where("side = 'storage'"), [F.desc("confidence"), F.col("item")]).position("__r").done()
    return labelled.where("side = 'share'").unionByName(ranked.where(F.col("__r") <= ratio * shared).drop("__r"))


def evenly(reasons: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """``keep`` rows evenly spaced over ``order``: positions floor(i * n / keep)."""
    n = reasons.count()
    if keep >= n:
        return reasons
    ranked = Ordered(reasons, order).position("__r").done().withColumn("__r", F.col("__r") - 1)
    hit = F.ceil(F.col("__r") * F.lit(keep) / F.lit(n)).cast("long")  # the i that could have landed here
    return ranked.where((hit < keep) & (F.floor(hit * F.lit(n) / F.lit(keep)) == F.col("__r"))).drop("__r")


def session_stats(pairs: DataFrame, sessions: DataFrame, ready_at: int = 15) -> DataFrame:
    """Per session: comparisons by type and choice, distinct labelled items, their share of the session's files in
    percent, and whether there are enough. pairs: session_id, photo_a, photo_b, choice (clean), comparison_type;
    sessions: session_id, total_files."""
    items = pairs.where("choice is not null").select("session_id", F.explode(F.array("photo_a", "photo_b")).alias("item"))
    labelled = items.where("item is not null").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("labelled"))
    kinds = [F.count_if(F.col("comparison_type") == k).alias(k) for k in ("within_burst", "between_burst")]
    picks = [F.count_if(F.col("choice") == k).alias(f"chose_{k}") for k in ("left", "right", "both", "neither")]
    n = pairs.where("choice is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("comparisons"), *kinds, *picks)
    cover = F.when(F.col("total_files") > 0, F.bround(100.0 * F.col("labelled") / F.col("total_files"), 1)).otherwise(0.0)
    zero = ["comparisons", "within_burst", "between_burst", *(f"chose_{k}" for k in ("left", "right", "both", "neither")), "labelled"]
    return sessions.join(n, "session_id", "left").join(labelled, "session_id", "left").na.fill(0, zero).select(
        "session_id", *zero, cover.alias("coverage"), (F.col("comparisons") >= ready_at).alias("ready")
    )


def burst_candidates(bursts: DataFrame, labelled: DataFrame, least: int = 2) -> DataFrame:
    """(session_id, burst_no, unlabelled) for bursts that still hold ``least`` unlabelled items, as sources of the next
    comparison. bursts: session_id, burst_no, item; labelled: session_id, item."""
    left = bursts.distinct().join(labelled, ["session_id", "item"], "left_anti")
    return left.groupBy("session_id", "burst_no").agg(F.count(F.lit(1)).alias("unlabelled")).where(F.col("unlabelled") >= least)


def representatives(bursts: DataFrame) -> DataFrame:
    """One item per burst, by hash, for comparisons between bursts."""
    return bursts.groupBy("session_id", "burst_no").agg(F.min_by("item", F.struct(F.md5("item").alias("h"), F.col("item").alias("i"))).alias("item"))


def _top_share(rows: DataFrame, least: int, part: int, order: list[Column]) -> DataFrame:
    """Of each session the first max(least, n // part) rows in ``order``; a session has as many rows as bursts."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    placed = rows.withColumn("__n", n).withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order)))
    return placed.where(F.col("place") <= F.greatest(F.lit(least), F.floor(F.col("__n") / part))).drop("__n")


def pair_sources(candidates: DataFrame) -> DataFrame:
    """The bursts from which the two items of the next comparison within a burst are drawn: of each session the first
    max(3, n // 3) of ``burst_candidates`` by unlabelled items, ties by burst_no."""
    return _top_share(candidates, 3, 3, [F.desc("unlabelled"), F.asc("burst_no")])


def gallery_sources(bursts: DataFrame, labelled: DataFrame, large: int = 5, unlabelled: int = 3) -> DataFrame:
    """The bursts that may be shown as a gallery: ``large`` items or more, ``unlabelled`` of them without a label; of each
    session the first max(2, n // 2) by unlabelled items, ties by burst_no. bursts, labelled: as in burst_candidates."""
    sizes = bursts.distinct().groupBy("session_id", "burst_no").agg(F.count(F.lit(1)).alias("items"))
    rows = burst_candidates(bursts, labelled, unlabelled).join(sizes.where(F.col("items") >= large), ["session_id", "burst_no"])
    return _top_share(rows, 2, 2, [F.desc("unlabelled"), F.asc("burst_no")])


def gallery_items(sources: DataFrame, placed: DataFrame, shown: int = 20) -> DataFrame:
    """(session_id, burst_no, position, item): the first ``shown`` items of each gallery. placed: session_id, burst_no,
    position (from 0), item."""
    return placed.where(F.col("position") < shown).join(sources.select("session_id", "burst_no"), ["session_id", "burst_no"])


def recorded(choices: DataFrame, kind: str) -> DataFrame:
    """Answers of a training session as rows to append: 2.0 for a comparison within a burst, 1.0 between bursts, 1.5 for
    a gallery."""
    weight = F.when(F.col(kind) == "within_burst", 2.0).when(F.col(kind) == "gallery", 1.5).otherwise(1.0)
    return choices.withColumn("weight", weight)


def samples(examples: DataFrame, side: str, position: Column, present: DataFrame, item: str, most: int = 50) -> DataFrame:
    """The first ``most`` examples of each side, in the order of ``position``, whose item is still there."""
    there = examples.join(present.select(item).distinct(), item, "left_semi")
    salted = Window.partitionBy(side, F.pmod(F.xxhash64(item), F.lit(64))).orderBy(position, item)
    first = there.withColumn("__r", F.row_number().over(salted)).where(F.col("__r") <= most)
    final = Window.partitionBy(side).orderBy(position, item)
    return first.withColumn("place", F.row_number().over(final)).where(F.col("place") <= most).drop("__r")


def moves(report: DataFrame, actual: DataFrame, name: str, was: str, now: str) -> DataFrame:
    """Items whose place now differs from the reported one, joined by name."""
    return report.join(actual, name).where(F.col(was) != F.col(now)).select(name, was, now)


def transitions(moved: DataFrame, was: str, now: str) -> DataFrame:
    return moved.groupBy(was, now).agg(F.count(F.lit(1)).alias("n"))


def balanced_categories(examples: DataFrame, category: str, order: list[Column], ratio: int = 3) -> DataFrame:
    """``examples`` with every category cut to ``ratio`` times the smallest one, first rows in ``order``. Places within
    a category come from one global order, so a category with most rows is no task of its own."""
    ranked = Ordered(examples, [F.col(category), *order]).position("__r").done()
    spans = ranked.groupBy(F.col(category).alias("__c")).agg(F.min("__r").alias("__s"), F.count(F.lit(1)).alias("__n"))
    spans = spans.withColumn("__m", F.min("__n").over(Window.partitionBy()))  # one row a category
    out = ranked.join(spans, F.col(category).eqNullSafe(F.col("__c")))
    return out.where(F.col("__r") - F.col("__s") < F.col("__m") * ratio).drop("__r", "__c", "__s", "__n", "__m")


def reasons_by_category(feedback: DataFrame, most: int = 20) -> DataFrame:
    """(category, n, reasons): corrections per category, a missing one is 'unknown', with the first ``most`` reasons in
    the order of submission. feedback: file_path, correct_category, reasoning, submitted_at."""
    named = feedback.withColumn("category", F.coalesce("correct_category", F.lit("unknown")))
    n = named.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    said = named.where(F.trim("reasoning") != "").select("category", "reasoning", "submitted_at", "file_path")
    ranked = Ordered(said, [F.col(c) for c in ("category", "submitted_at", "file_path", "reasoning")]).position("__r").done()
    first = ranked.groupBy("category").agg(F.min("__r").alias("__s"))
    kept = ranked.join(first, "category").where(F.col("__r") - F.col("__s") < most)
    lists = kept.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("__r", "reasoning"))).alias("l"))
    return n.join(lists, "category", "left").select("category", "n", F.coalesce(F.transform("l", lambda x: x["reasoning"]), F.array()).alias("reasons"))


def recent(feedback: DataFrame, most: int = 20) -> DataFrame:
    """The last ``most`` corrections, oldest of them first; those of one file at one time go by category."""
    last = feedback.orderBy(F.desc_nulls_last("submitted_at"), F.desc("file_path"), F.desc("correct_category")).limit(most)
    return last.orderBy(F.asc_nulls_first("submitted_at"), "file_path", "correct_category")


def corrections(moved: DataFrame, known: DataFrame, name: str, was: str, now: str) -> DataFrame:
    """(name, category, confidence, source): moves as corrections, sure (5) between sharing and storing, else 4; a move
    takes the place of a known correction of the same item. known: name, category, confidence."""
    sure = F.col(was).isin("Share", "Storage") & F.col(now).isin("Share", "Storage")
    new = moved.select(name, F.col(now).alias("category"), F.when(sure, 5).otherwise(4).alias("confidence"), F.lit("move").alias("source"))
    old = known.select(name, "category", "confidence", F.lit("known").alias("source")).join(new.select(name), name, "left_anti")
    return new.unionByName(old)


def threshold_advice(moves_table: DataFrame, was: str, now: str) -> DataFrame:
    """(direction, n): how often items were moved up to Share, or down from it."""
    way = F.when(F.col(now) == "Share", "lower the threshold").when(F.col(was) == "Share", "raise the threshold").otherwise("keep")
    return moves_table.groupBy(way.alias("direction")).agg(F.count(F.lit(1)).alias("n"))


def share_ratio(examples: DataFrame, side: str = "side", usual: float = 0.275) -> float:
    """Share of examples on the sharing side; the usual one where there are none."""
    row = examples.agg(F.avg((F.lower(side) == "share").cast("double")).alias("r")).first()
    return usual if row["r"] is None else row["r"]


#: How often each kind of comparison is served where all are possible.
KINDS = {"within_burst": 0.5, "between_burst": 0.3, "gallery": 0.2}


def next_kind(possible: set[str], served: int, seed: int = 1337) -> str | None:
    """The kind of the next comparison: drawn by weight among the possible ones, the same for the same number served."""
    import random

    names = [k for k in KINDS if k in possible]
    if not names:
        return None
    return random.Random(seed * 1_000_003 + served).choices(names, [KINDS[k] for k in names])[0]
