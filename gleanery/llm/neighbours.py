"""Problem 2: the k most similar vectors for every vector.

Method: Gaussian (2-stable) projections to a few dimensions, indexed by kd-trees. In a leaf, a row's neighbours are taken
in the order of their projected distance and verified by exact cosines, until the chi-square test says that what is
further off in projection is unlikely to be nearer than the k-th one verified. What lies outside the leaf is judged by
the same law: the chance that a neighbour at the distance of the k-th fell into the leaf's box. A row asks tree after
tree, each with projections of its own, until the chance that all of them missed a neighbour is small enough; rows that
no longer ask stay in the trees as data for the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.kdtree import KdTree, chi_square_reach, inside
from gleanery.llm.vectors import SLACK, cosines, distinct_vectors, matrix, unit
from gleanery.scratch import Scratch

_STATE = "rep long, vec array<float>, miss double, best array<struct<c:double,other:long>>"


def _listed(rank_c: np.ndarray, other: np.ndarray, counts: np.ndarray) -> pa.Array:
    flat = pa.StructArray.from_arrays([pa.array(rank_c), pa.array(other)], names=["c", "other"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)


def _start(points: DataFrame) -> DataFrame:
    return points.select(
        "rep", "vec", F.lit(1.0).alias("miss"), F.expr("cast(array() as array<struct<c:double,other:long>>)").alias("best")
    )


class _Tree:
    """A tree with its projections, and what its searches need to know."""

    def __init__(self, fit: np.ndarray, dims: int, depth: int, seed: int, leaf_rows: int, within: float):
        self.basis = np.random.default_rng(seed).standard_normal((fit.shape[1], dims)).astype(np.float32)
        self.tree = KdTree(fit.astype(np.float32) @ self.basis, depth)
        self.leaf_rows, self.within, self.dims = leaf_rows, within, dims
        self.reach = chi_square_reach(within, dims)

    def project(self, u: np.ndarray) -> np.ndarray:
        return u.astype(np.float32) @ self.basis

    def found(self, p: np.ndarray, box: tuple[np.ndarray, np.ndarray], distance: np.ndarray) -> np.ndarray:
        """The least chance that a search of the box finds a vector at ``distance`` from each row."""
        return np.maximum(0.0, inside(p, *box, distance) - (1 - self.within))

    def parts(self, leaf: int, p: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """The rows of a leaf with their box; a leaf that is overfull (the sample saw it as smaller, or the tree has as
        many leaves as it may) is divided by a local tree over its own rows."""
        low, high = self.tree.box(leaf)
        depth = math.ceil(math.log2(len(p) / (4 * self.leaf_rows))) + 1 if len(p) > 4 * self.leaf_rows else 0
        if not depth:
            yield np.arange(len(p)), (low, high)
            return
        local = KdTree(p[:: max(1, len(p) // (64 << depth))], depth)
        at = local.leaves(p)
        order = np.argsort(at, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            a, b = local.box(int(at[rows[0]]))
            yield rows, (np.maximum(low, a), np.minimum(high, b))


def _leaf_of(tree: _Tree, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.tree.leaves(tree.project(unit(matrix(b.column("vec"), dim)))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    return run


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix, several times as fast where few are true: the flat search skips what is false by words."""
    return np.divmod(np.flatnonzero(hit), max(1, hit.shape[1]))


def _verified(u: np.ndarray, p: np.ndarray, asks: np.ndarray, radius: np.ndarray, k: int, limit: float, reach: float, first: int = 64):
    """(i, j, cosine) of the pairs verified for the rows ``asks``: neighbours in rings of growing projected distance d, as
    far as d * d is at most ``reach`` times the square of the distance to the k-th one so far (``radius`` at the start).

    Rows with at most ``first`` others that near verify them all. Others verify about their nearest ``first``, which
    tells the k-th, then all that are still within its reach; where these are more than ``first`` times eight (in a tight
    group all are about as near as the k-th) by one product with the leaf in single precision, and exactly near the end
    of the list."""
    small = np.ascontiguousarray(u.astype(np.float32))
    # half the negative squared projected distance as one product: (p, -p.p/2, 1) . (q, 1, -q.q/2)
    half = -0.5 * np.einsum("ij,ij->i", p, p)
    one = np.ones(len(p), np.float32)
    left = np.ascontiguousarray(np.column_stack([p, half, one]).astype(np.float32))
    right = np.ascontiguousarray(np.column_stack([p, one, half]).astype(np.float32).T)
    slack = 1e-5 * float(np.abs(half).max(initial=1.0))
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def verify(rows: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = cosines(u, rows, j)
        ok = c >= limit
        pairs.append((rows[ok], j[ok], c[ok]))
        return ok, c

    step = max(1, 4_000_000 // max(1, len(p)))
    apart = max(1, len(p) // 512)
    for s in range(0, len(asks), step):
        rows = asks[s : s + step]
        near = left[rows] @ right
        near[np.arange(len(rows)), rows] = -np.inf
        bound = (-0.5 * reach * radius[s : s + step] ** 2 - slack).astype(np.float32)
        hit = near >= bound[:, None]
        many = np.flatnonzero(np.count_nonzero(hit, axis=1) > first)
        hit[many] = False
        i, j = _places(hit)
        verify(rows[i], j)
        if not len(many):
            continue
        near, bound, rows = near[many], bound[many], rows[many]
        place = max(1, first // apart) - 1  # of the about first-nearest in every apart-th column
        edge = -np.partition(-near[:, ::apart], place, axis=1)[:, place]
        i, j = _places(near >= np.maximum(edge, bound)[:, None])
        ok, c = verify(rows[i], j)
        i, c = i[ok], c[ok]
        order = np.lexsort((-c, i))
        i, c = i[order], c[order]
        kth = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
        bound[i[kth]] = np.maximum(bound[i[kth]], -reach * (1 - c[kth]) - slack)
        hit = (near >= bound[:, None]) & (near < edge[:, None])
        left_over = np.count_nonzero(hit, axis=1)
        dense = np.flatnonzero(left_over > 8 * first)
        hit[dense] = False
        i, j = _places(hit)
        verify(rows[i], j)
        if len(dense):
            sim = small[rows[dense]] @ small.T
            sim[np.arange(len(dense)), rows[dense]] = -2.0
            top = min(k, len(small)) - 1
            last = -np.partition(-sim, top, axis=1)[:, top]
            i, j = _places(sim >= np.maximum(last - SLACK, limit - SLACK)[:, None])
            verify(rows[dense[i]], j)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(x) for x in zip(*(pairs or [empty])))


def _search_leaf(tree: _Tree, dim: int, k: int, limit: float, radius: float, sure: float):
    """Rows of one leaf with what they had found before -> the same rows with the leaf's finds merged in. Rows with
    miss <= 1 - sure no longer ask."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep").combine_chunks()
        rep, miss = table["rep"].to_numpy(), table["miss"].to_numpy().copy()
        u = unit(matrix(table["vec"], dim))
        p = tree.project(u)
        best = table["best"].combine_chunks()
        had = best.value_lengths().to_numpy(zero_copy_only=False)
        old = best.flatten()
        old_i, old_c = np.repeat(np.arange(len(rep)), had), old.field("c").to_numpy(zero_copy_only=False)
        finds = [(old_i, old_c, old.field("other").to_numpy(zero_copy_only=False))]
        dist = np.full(len(rep), radius)
        full = had >= k
        dist[full] = np.sqrt(np.maximum(0.0, 2 - 2 * old_c[np.cumsum(had)[full] - 1]))
        places = list(tree.parts(table["leaf"][0].as_py(), p))
        for rows, _ in places:
            asks = np.flatnonzero(miss[rows] > 1 - sure)
            i, j, c = _verified(u[rows], p[rows], asks, dist[rows[asks]], k, limit, tree.reach)
            finds.append((rows[i], c, rep[rows[j]]))
        i, c, o = (np.concatenate(x) for x in zip(*finds))
        order = np.lexsort((o, -c, i))
        i, c, o = i[order], c[order], o[order]
        fresh = np.ones(len(i), bool)
        fresh[1:] = (i[1:] != i[:-1]) | (o[1:] != o[:-1])
        i, c, o = i[fresh], c[fresh], o[fresh]
        rank = np.arange(len(i)) - np.searchsorted(i, np.arange(len(rep)))[i]
        keep = rank < k
        i, c, o, rank = i[keep], c[keep], o[keep], rank[keep]
        full = rank == k - 1
        dist[i[full]] = np.sqrt(np.maximum(0.0, 2 - 2 * c[full]))
        for rows, box in places:
            asks = rows[miss[rows] > 1 - sure]
            miss[asks] *= 1 - tree.found(p[asks], box, dist[asks])
        return pa.table(
            {"rep": pa.array(rep), "vec": table["vec"], "miss": miss, "best": _listed(c, o, np.bincount(i, minlength=len(rep)))}
        )

    return run


def _planned(fit: np.ndarray, grow, radius: float, sure: float, most: int, all_but: float = 0.02, looked_at: int = 2000) -> list[_Tree]:
    """Trees until the test holds, at the limit's distance, for all but a share of the sample. Rows whose neighbours are
    nearer stop before; the few that lie by the borders of every tree may still ask after the last one."""
    trees, some = [], fit[:looked_at]
    miss = np.ones(len(some))
    while len(trees) < most and (not trees or np.quantile(miss, 1 - all_but) > 1 - sure):
        tree = grow(len(trees))
        trees.append(tree)
        p = tree.project(some)
        at = tree.tree.leaves(p)
        for leaf in np.unique(at):
            rows = np.flatnonzero(at == leaf)
            miss[rows] *= 1 - tree.found(p[rows], tree.tree.box(int(leaf)), np.full(len(rows), radius))
    return trees


def _rest(state: DataFrame, points: DataFrame, dim: int, k: int, limit: float, sure: float, block_rows: int) -> DataFrame:
    """``state`` with the rows that still ask compared with all rows, block by block."""
    scratch = Scratch(state.sparkSession)
    state = scratch.keep(state)
    asked = state.where(F.col("miss") > 1 - sure).select("rep", "vec")
    blocks = max(1, -(-points.count() // block_rows))
    asking = max(1, -(-asked.count() // block_rows))
    mine, theirs = F.pmod(F.xxhash64("rep"), F.lit(asking)).cast("int"), F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("rep", "vec", mine.alias("a"), every(blocks).alias("b"), F.lit(True).alias("asks"))
    right = points.select("rep", "vec", every(asking).alias("a"), theirs.alias("b"), F.lit(False).alias("asks"))

    def run(table: pa.Table) -> pa.Table:
        rep, asks = table["rep"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        u = unit(matrix(table["vec"], dim))
        own, all_ = np.flatnonzero(asks), np.flatnonzero(~asks)
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = np.ascontiguousarray(u[all_].astype(np.float32))
        step = max(1, 4_000_000 // max(1, len(all_)))
        for s in range(0, len(own), step):
            sim = u[own[s : s + step]].astype(np.float32) @ small.T
            x, y = np.nonzero(sim >= limit - SLACK)
            i.append(own[s + x])
            j.append(all_[y])
        i, j = np.concatenate(i), np.concatenate(j)
        c = cosines(u, i, j)
        ok = (c >= limit) & (rep[i] != rep[j])
        i, j, c = i[ok], j[ok], c[ok]
        order = np.lexsort((rep[j], -c, i))
        i, j, c = i[order], j[order], c[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pa.table({"rep": rep[i[keep]], "c": c[keep], "other": rep[j[keep]]})

    found = left.unionByName(right).groupBy("a", "b").applyInArrow(run, "rep long, c double, other long")
    pair = F.struct((-F.col("c")).alias("c"), "other")
    lists = found.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(pair)), 1, k).alias("all"))  # k a block at most
    whole = F.transform("all", lambda x: F.struct((-x["c"]).alias("c"), x["other"].alias("other")))
    out = state.join(lists, "rep", "left")
    asks = F.col("miss") > 1 - sure
    none = F.expr("cast(array() as array<struct<c:double,other:long>>)")
    return out.select("rep", "vec", F.when(asks, 0.0).otherwise(F.col("miss")).alias("miss"), F.when(asks, F.coalesce(whole, none)).otherwise(F.col("best")).alias("best"))


def similar_classes(
    points: DataFrame, dim: int, k: int, limit: float, dims: int = 32, leaf_rows: int = 8192, sure: float = 0.99, planned: float = 0.9,
    within: float = 0.999999, max_trees: int = 64, max_leaves: int = 2**15, seed: int = 7, exact: bool = False, block_rows: int = 8192,
) -> DataFrame:
    """(rep, vec, miss, best): for every distinct vector its k most similar other vectors with a cosine of ``limit``
    or more, and the bound of the chance that a neighbour as near as the k-th (or as the limit, where there are fewer)
    was missed. A row stops asking when it is at most 1 - sure. Rows with k neighbours near by do so soon; the trees are as
    many as bring the bound to 1 - planned for a neighbour at the limit itself, which is the hardest to find. Rows with
    miss > 1 - sure, mostly such with fewer than k neighbours, stopped without the test; with ``exact`` they are compared
    with all rows.

    A tree is fitted on 32 rows a leaf, 16,384 to 262,144 in all, chosen by a hash of the id; every row is indexed. A leaf
    holds leaf_rows to 2*leaf_rows rows on average, so work grows in proportion to the rows, and with the number of
    trees, which rises with the depth (about twofold for a thousand times the rows): as many as the test needs, at most
    ``max_trees``. Beyond max_leaves leaves, a leaf's task divides its rows by a local tree. A row travels with its
    finds from tree to tree: one shuffle of the rows per tree, and no join."""
    total = points.count()
    depth = max(0, min(int(math.log2(max_leaves)), int(math.log2(max(total, 1) / leaf_rows))))
    wanted = min(max(16384, 32 << depth), 262_144)
    share = min(1.0, wanted / max(total, 1))
    picked = points.where(F.pmod(F.xxhash64("rep"), F.lit(100_000_000)) < math.ceil(share * 100_000_000)).select("vec")
    sample = picked.toArrow()
    fit = unit(matrix(sample["vec"], dim)).astype(np.float32) if sample.num_rows else np.zeros((0, dim), np.float32)
    radius = math.sqrt(max(0.0, 2 - 2 * limit))
    grow = lambda t: _Tree(fit, dims, depth, seed + t, leaf_rows, within)
    trees = _planned(fit, grow, radius, planned, max_trees) if depth else [grow(0)]
    state = _start(points)
    for tree in trees:
        placed = state.mapInArrow(_leaf_of(tree, dim), f"{_STATE}, leaf long")
        state = placed.groupBy("leaf").applyInArrow(_search_leaf(tree, dim, k, limit, radius, sure), _STATE)
    return _rest(state, points, dim, k, limit, sure, block_rows) if exact else state


def nearest(
    df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, limit: float = 0.85, **tuning
) -> DataFrame:
    """(id, other, cosine, rank): the k nearest other rows of every row with a usable vector, as far as the cosine is
    at least ``limit``; equal cosines (rounded to 9 decimals) go by the smaller id.

    Ids stand for one vector each; equal rows repeated under one id count once. Null ids, null, empty, zero and
    non-finite vectors and such of another length are no rows; an empty table gives an empty result; extra columns are ignored. Exact copies are collapsed first: a copy
    class stands for its k+1 smallest ids in the lists of others, so a class with a third of all rows costs no more.
    """
    scratch = Scratch(df.sparkSession)
    plain, rows = distinct_vectors(df, id_col, vec_col, dim)
    classes = scratch.keep(plain)
    points = classes.select("rep", "vec")
    found = similar_classes(points, dim, k, limit, **tuning)
    # members: every id with its class; first: the k+1 smallest ids of each class, ranked in two salted stages
    several = classes.where("n > 1").select("f1", "f2", "rep")
    copies = rows.join(several, ["f1", "f2"]).select("rep", "id").distinct()
    copies = scratch.keep(copies)
    salted = Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("rep").orderBy("id")
    head = copies.withColumn("r", F.row_number().over(salted)).where(f"r <= {k + 1}")
    head = head.withColumn("r", F.row_number().over(whole)).where(f"r <= {k + 1}").select("rep", "id")
    head = head.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    near = found.select("rep", F.explode("best").alias("b")).select("rep", F.col("b.other").alias("other"), F.col("b.c").alias("c"))
    near = near.unionByName(several.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("c")))
    near = near.join(head.withColumnRenamed("rep", "other"), "other", "left").select(
        "rep", "c", F.explode(F.coalesce("ids", F.array("other"))).alias("other")
    )
    # per class at most (k+1)*(k+1) candidates
    lists = near.groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("d"), F.col("other").alias("other")))).alias("best")
    ).select("rep", F.slice("best", 1, k + 1).alias("best"))
    members = copies.unionByName(classes.where("n = 1").select("rep", F.col("rep").alias("id")))
    lists = members.join(lists, "rep").select(
        "id", F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k).alias("best")
    )
    return lists.select("id", F.posexplode("best").alias("at", "b")).select(
        "id", F.col("b.other").alias("other"), (-F.col("b.d")).alias("cosine"), (F.col("at") + 1).alias("rank")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature_a, feature_b): pairs of which at least one row is among the other's five nearest."""
    df = spark.read.parquet(f"{sf_dir}/document_features.parquet").select("feature_id", "embedding")
    near = nearest(df, "feature_id", "embedding", dim=64, k=5, limit=0.85)
    return near.select(
        F.least("id", "other").alias("feature_a"), F.greatest("id", "other").alias("feature_b")
    ).distinct()
