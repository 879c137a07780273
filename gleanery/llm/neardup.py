"""Problem 3: records that share most of their content but differ by small edits, insertions or reordering.

Method: SetSketch. A text's set of word shingles is sketched by registers K_i = floor(1 - log_b(min of exponential
hashes)), truncated to one byte; sketches of unions are register-wise maxima, and registers agree with a probability
that follows the Jaccard similarity. Bands of registers select candidates, a few bits of all registers travel with the
bands to discard chance meetings, the register comparison of both texts gives the similarity by maximum likelihood,
and what remains is verified on the shingle sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import word_hashes
from gleanery.operators.components import connected_components
from gleanery.scratch import Scratch

#: Base, rate and number of the registers; one byte holds b**254 ~ 3e8 different scales.
BASE, RATE, REGISTERS = 1.08, 10.0, 128


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of ``width`` words of each row of a list column of word hashes, sorted."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    w = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(w) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(w))  # words up to the row's end
    h = np.zeros(len(w) - width + 1, np.uint64)
    for i in range(width):
        h = _mix(h + w[i : len(w) - width + 1 + i] + np.uint64(i + 1))
    whole = left[: len(h)] >= width
    row, h = row[: len(h)][whole], h[whole]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def sketch(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first positions, registers) for sorted rows: one sketch of REGISTERS bytes per distinct row."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    regs = np.zeros((len(first), REGISTERS), np.uint8)
    if not len(first):
        return first, regs
    odd = np.random.default_rng(2021).integers(1, 2**63, (REGISTERS, 2), dtype=np.uint64)
    for i in range(REGISTERS):
        x = h * (odd[i, 0] | np.uint64(1)) + odd[i, 1]
        x ^= x >> np.uint64(32)
        x *= odd[i, 1] | np.uint64(1)
        u = np.minimum.reduceat(x >> np.uint64(12), first)  # the smallest uniform gives the smallest exponential
        e = -np.log1p(-(u.astype(np.float64) + 0.5) / 2**52) / RATE
        regs[:, i] = np.clip(np.floor(1 - np.log(e) / math.log(BASE)), 0, 255)
    return first, regs


def joint_similarity(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the numbers of registers in which the first sketch is larger and
    smaller, given both set sizes."""
    share = (na / (na + nb))[:, None]
    most = np.minimum(na, nb) / np.maximum(na, nb)
    grid = np.linspace(0.0, 1.0, 201)[None, :]
    j = np.minimum(grid, most[:, None])
    scale = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log(1 - np.maximum(x, 0) * scale) / math.log(BASE), 1e-9)

    up, down = p(share - (1 - share) * j), p((1 - share) - share * j)
    same = np.maximum(1 - up - down, 1e-9)
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (REGISTERS - more - less)[:, None] * np.log(same)
    return j[np.arange(len(fit)), fit.argmax(axis=1)]


def banding(limit: float, recall: float = 0.9995) -> tuple[int, int]:
    """(registers per band, bands): the longest bands that still find pairs at ``limit`` with ``recall``."""
    if recall >= 1:
        return 1, REGISTERS
    for width in range(8, 0, -1):
        chance = limit**width
        need = math.ceil(math.log(1 - recall) / math.log(1 - chance)) if chance < 1 else 1
        if need * width <= REGISTERS:
            return width, need
    return 1, REGISTERS


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, h = shingles(b.column("words"), width)
            first, regs = sketch(row, h)
            size = np.diff(np.r_[first, len(row)])
            mixed = _mix(h + np.uint64(77))
            f1 = np.add.reduceat(h, first) if len(first) else h
            f2 = np.add.reduceat(mixed, first) if len(first) else h
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(row[first])), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                    pa.array(size.astype(np.int32)), pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                ["id", "f1", "f2", "size", "regs"],
            )

    return run


def _banded(width: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            keys = np.zeros((len(regs), bands), np.uint64)
            for i in range(bands):
                k = np.full(len(regs), i + 1, np.uint64)
                for j in range(width):
                    k = _mix(k + regs[:, i * width + j] * np.uint64(0x9E3779B1) + np.uint64(1))
                keys[:, i] = k
            bits = np.packbits(regs & 1, axis=1).view(np.int64)
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(regs) * bands + 1, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), b.column("size"), pa.array(bits[:, 0]), pa.array(bits[:, 1]), flat],
                ["rep", "size", "s1", "s2", "keys"],
            )

    return run


def _estimated(limit: float):
    least = limit - 4 * math.sqrt(limit * (1 - limit) / REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (
                np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("ra", "rb")
            )
            j = joint_similarity(
                (x > y).sum(axis=1), (x < y).sum(axis=1),
                b.column("na").to_numpy().astype(float), b.column("nb").to_numpy().astype(float),
            )
            keep = pa.array(np.flatnonzero(j >= least))
            yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], ["a", "b"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, h = shingles(b.column("words"), width)
            n = np.bincount(row, minlength=b.num_rows)
            flat = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(h.view(np.int64))
            )
            yield pa.RecordBatch.from_arrays([b.column("id"), flat], ["id", "set"])

    return run


def _verified(met: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, either) of candidate pairs (a, b), counted on the shingle sets (id, set)."""
    common = F.size(F.array_intersect("sa", "sb"))
    both = met.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("either"))


def near_duplicate_links(
    df: DataFrame, id_col: str, text_col: str, width: int = 5, limit: float = 0.8, recall: float = 0.9995, hot: int = 200
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, pairs, balls, sets); members and pairs as in ``near_duplicates``, but the pairs within a ball are left
    out. balls: (rep, ball): representatives that all have a similarity of ``limit`` or more with each other. sets: (id,
    set) of the representatives that occur in pairs or balls.

    Where more than ``hot`` representatives share a band, they are compared with one of them only, the pivot. The Jaccard
    distance is a metric, so those within half the limit's distance of a pivot are a ball: linked with each other
    without looking at their pairs. Only representatives outside of balls, and those of different balls, meet in pairs.
    So a group of n texts near one text costs in proportion to n."""
    scratch = Scratch(df.sparkSession)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    texts = texts.select("id", word_hashes(F.col("text")).alias("words")).where(F.size("words") >= width)
    kind = dict(texts.dtypes)["id"]
    rows = scratch.keep(texts.mapInArrow(_sketched(width), f"id {kind}, f1 long, f2 long, size int, regs binary"))
    classes = rows.groupBy("f1", "f2").agg(
        F.min("id").alias("rep"), F.min("size").alias("size"), F.min_by("regs", "id").alias("regs")
    )
    classes = scratch.keep(classes)
    per, bands = banding(limit, recall)
    keyed = classes.select("rep", "size", "regs").mapInArrow(
        _banded(per, bands), f"rep {kind}, size int, s1 long, s2 long, keys array<long>"
    )
    keyed = keyed.select("rep", "size", "s1", "s2", F.explode("keys").alias("key"))

    def set_of(wanted: DataFrame) -> DataFrame:
        found = texts.join(wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
        return scratch.keep(found.mapInArrow(_sets(width), f"id {kind}, set array<long>").dropDuplicates(["id"]))

    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).where(F.col("n") > hot)
    crowded = scratch.keep(crowded.select("key", "pivot"))
    balls = scratch.keep(classes.select("rep", F.col("rep").alias("ball")).limit(0))
    ball_sets = None
    if not crowded.isEmpty():
        near = scratch.keep(keyed.join(crowded, "key").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct())
        ball_sets = set_of(near.select(F.col("a").alias("rep")).union(near.select("b")))
        close = _verified(near, ball_sets).where(F.col("common") * 2 >= (1 + limit) * F.col("either") + 1e-9)
        own = near.where("a = b").select("a", "b")  # a pivot is in its ball, unless in one of a smaller pivot
        balls = close.select("a", "b").union(own).groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("ball"))
        balls = scratch.keep(balls)
        keyed = scratch.keep(keyed.join(balls, "rep", "left"))
    # bits of equal registers agree, those of others by chance: 4.2 standard deviations above what the limit expects
    odds = (1 - limit) / 2
    differ = math.ceil(REGISTERS * odds + 4.2 * math.sqrt(REGISTERS * odds * (1 - odds)))
    alike = (F.least("a.size", "b.size") >= limit * F.greatest("a.size", "b.size") - 1e-9) & (
        F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2"))) <= differ
    )
    a, b, same = keyed.alias("a"), keyed.alias("b"), F.col("a.key") == F.col("b.key")
    ends = [F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")]
    if ball_sets is None:
        met = a.join(b, same & (F.col("a.rep") < F.col("b.rep")) & alike).select(*ends)
    else:
        alone = keyed.where("ball is null").alias("a")
        once = (F.col("a.rep") < F.col("b.rep")) | F.col("b.ball").isNotNull()
        met = alone.join(b, same & once & (F.col("a.rep") != F.col("b.rep")) & alike).select(*ends)
        held = keyed.where("ball is not null").select("key", "ball").distinct()
        two = held.alias("x").join(held.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.ball") < F.col("y.ball")))
        two = two.select("x.key", F.col("x.ball").alias("first"), F.col("y.ball").alias("second"))  # of a key, pairs of its balls
        here = (F.col("k.key") == F.col("t.key")) & (F.col("k.ball") == F.col("t.first"))
        left = keyed.alias("k").join(two.alias("t"), here).select("k.rep", "k.size", "k.s1", "k.s2", "k.key", "t.second")
        left, right = left.alias("a"), keyed.alias("b")
        across = left.join(right, same & (F.col("a.second") == F.col("b.ball")) & alike).select(*ends)
        met = met.union(across)
    met = met.distinct()
    side = classes.select("rep", "size", "regs")
    both = met.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b")
    likely = scratch.keep(both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated(limit), f"a {kind}, b {kind}"))
    sets = set_of(likely.select(F.col("a").alias("rep")).union(likely.select("b")))
    pairs = _verified(likely, sets).where(F.col("common") >= limit * F.col("either") - 1e-9).select(
        "a", "b", (F.col("common") / F.col("either")).alias("similarity")
    )
    members = rows.join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select("id", "rep").distinct()
    return members, pairs, balls, sets if ball_sets is None else sets.union(ball_sets).dropDuplicates(["id"])


def ball_pairs(balls: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs that balls stand for."""
    x, y = balls.alias("x"), balls.alias("y")
    met = x.join(y, (F.col("x.ball") == F.col("y.ball")) & (F.col("x.rep") < F.col("y.rep")))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, width: int = 5, limit: float = 0.8, **tuning
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs). members: (id, rep) for every record with at least ``width`` words, rep being the smallest id
    with the same shingle set. pairs: (a, b, similarity) of such representatives, a < b, with a Jaccard similarity of
    ``limit`` or more.

    Ids stand for one text each; equal rows repeated under one id count once, and of different texts under one id any
    may be the one compared. Null ids, null, empty and shorter texts are in neither; equal texts share a
    representative; very long texts are taken whole; an empty table gives empty results; extra columns are ignored.
    A group of equal texts, even a third of all rows, is one row in all joins. Pairs are found with a probability of
    ``recall`` (0.9995) at the limit, and more above it; all that are returned are exact. With recall=1 every pair that
    has a register in common is verified, which at these limits is every pair there is.
    """
    members, pairs, balls, sets = near_duplicate_links(df, id_col, text_col, width, limit, **tuning)
    inside = _verified(ball_pairs(balls), sets)
    return members, pairs.unionByName(inside.select("a", "b", (F.col("common") / F.col("either")).alias("similarity")))


def duplicate_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): the pairs of records that the pairs of representatives stand for, those inside a class included. As
    many as the definition asks for: a class of n equal texts has n(n-1)/2."""
    left, right = members.toDF("x", "a"), members.toDF("y", "b")
    across = pairs.select("a", "b").join(left, "a").join(right, "b")
    within = left.join(members.toDF("y", "a"), "a").where("x < y")
    return across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(
        within.select(F.col("x").alias("a"), F.col("y").alias("b"))
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/document_features.parquet").select("feature_id", "text_content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_a, feature_b): files whose texts share at least 70 % of their three-word sequences."""
    members, pairs, balls, _ = near_duplicate_links(_files(spark, sf_dir), "feature_id", "text_content", width=3, limit=0.7)
    return duplicate_pairs(members, pairs.select("a", "b").union(ball_pairs(balls))).select(F.col("a").alias("feature_a"), F.col("b").alias("feature_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file that has a near duplicate (five words, 0.8): its group, its class of equal texts and the
    number of other texts it is linked with."""
    found = near_duplicate_links(_files(spark, sf_dir), "feature_id", "text_content")
    return duplicate_groups(*found[:3]).select(
        F.col("id").alias("feature_id"), "group_id", F.col("rep").alias("class_id"), "links"
    )


def duplicate_groups(members: DataFrame, pairs: DataFrame, balls: DataFrame) -> DataFrame:
    """(id, group_id, rep, links) of every record with a near duplicate: its group, its class of equal texts, and the
    number of other texts it is linked with; balls count as a whole, their pairs are not made."""
    scratch = Scratch(members.sparkSession)
    pairs, members = scratch.keep(pairs.select("a", "b")), scratch.keep(members)
    hubs = balls.groupBy("ball").agg(F.min("rep").alias("hub"), (F.count(F.lit(1)) - 1).alias("mates"))
    inside = scratch.keep(balls.join(hubs, "ball").select("rep", "hub", "mates"))
    joined = pairs.union(inside.where("rep <> hub").select("rep", "hub"))
    groups = connected_components(joined, "a", "b").toDF("rep", "group_id")
    one = F.lit(1).cast("long").alias("links")
    ends = pairs.select(F.col("a").alias("rep"), one).union(pairs.select("b", one)).union(inside.where("mates > 0").select("rep", "mates"))
    links = ends.groupBy("rep").agg(F.sum("links").alias("links"))
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    tagged = members.join(sizes, "rep").join(groups, "rep", "left").join(links, "rep", "left")
    return tagged.where("copies > 1 or links is not null").select(
        "id", F.coalesce("group_id", "rep").alias("group_id"), "rep", F.coalesce("links", F.lit(0)).alias("links")
    )
