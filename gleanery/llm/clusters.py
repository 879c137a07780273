"""Problem 1: clusters of mutually similar records, each with its size and most typical members.

Method: records are vectorised (given embeddings, or hashed weighted word features), distributed k-means with parallel
oversampled seeding places cells on the dense places, and every record goes to its nearest cell and to those whose
border it is close to. Within a cell, records near the centre are one component at once, the others are linked by exact cosines;
components that share a record are one cluster. Members nearest a cluster's centroid describe it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions.text import word_hashes
from gleanery.llm.vectors import SLACK, cosines, distinct_vectors, lists, matrix, unit
from gleanery.operators.components import connected_components
from gleanery.scratch import Scratch


# --------------------------------------------------------------------------------------------- vectorise


def hashed_features(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, vec): words hashed into ``dim`` signed buckets, weighted by (1 + ln tf) * ln((1 + docs) / (1 + df)) with
    counts over all rows. Null or wordless text gives a null vector (such rows are in no cluster)."""
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    terms = base.select("id", F.explode(word_hashes(F.col("text"))).alias("w")).groupBy("id", "w").count()
    seen = terms.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    docs = base.count()
    weighed = terms.join(seen, "w").select(
        "id",
        F.pmod("w", F.lit(dim)).cast("int").alias("bucket"),
        (F.when(F.pmod(F.shiftright("w", 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
         * (1 + F.log("count")) * F.log(F.lit(1.0 + docs) / (1 + F.col("df")))).alias("x"),
    )
    cells = weighed.groupBy("id", "bucket").agg(F.sum("x").alias("x"))
    packed = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("m"))
    vec = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")
    )
    return base.select("id").join(packed, "id", "left").select("id", F.when(F.col("m").isNotNull(), vec).alias("vec"))


# --------------------------------------------------------------------------------------------- k-means


def _nearest(u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre and squared distance to it, in blocks."""
    at, d2 = np.zeros(len(u), np.int64), np.zeros(len(u))
    half = (c * c).sum(axis=1) / 2
    step = max(1, 4_000_000 // max(1, len(c)))
    for s in range(0, len(u), step):
        x = u[s : s + step]
        near = x @ c.T - half
        at[s : s + step] = near.argmax(axis=1)
        d2[s : s + step] = (x * x).sum(axis=1) - 2 * near.max(axis=1)
    return at, np.maximum(d2, 0.0)


def _uniform(rep: np.ndarray, salt: int) -> np.ndarray:
    x = (rep.astype(np.uint64) + np.uint64(salt * 1_000_003 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54


def kmeans(points: DataFrame, dim: int, k: int, rounds: int = 3, passes: int = 3, seed: int = 11) -> np.ndarray:
    """(k, dim) centres of unit vectors. points: rep, vec.

    Seeding (k-means||): in each round every partition draws rows with a chance in proportion to their squared
    distance to the seeds so far, k rows in all, kept as the k smallest exponential keys; the (rounds * k) weighted
    candidates are reclustered on the driver. Then ``passes`` Lloyd passes over all rows; only sums per centre leave
    the executors. What reaches the driver is bounded by rounds * k vectors, never by the rows.
    """

    def draw(centres: np.ndarray, salt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                u = unit(matrix(b.column("vec"), dim))
                d2 = _nearest(u, centres)[1] if len(centres) else np.ones(len(u))
                key = -np.log(_uniform(b.column("rep").to_numpy(), salt)) / np.maximum(d2, 1e-12)
                best = np.argsort(key, kind="stable")[:k]
                yield pa.RecordBatch.from_arrays([pa.array(key[best]), lists(u[best], dim)], ["key", "vec"])

        return run

    def sums(centres: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros(len(centres)), np.zeros((len(centres), dim))
            for b in batches:
                if b.num_rows:
                    u = unit(matrix(b.column("vec"), dim))
                    at = _nearest(u, centres)[0]
                    n += np.bincount(at, minlength=len(centres))
                    np.add.at(s, at, u)
            own = np.flatnonzero(n)
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(own) * dim + 1, dim, dtype=np.int32)), pa.array(s[own].ravel())
            )
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), flat], ["cell", "n", "sums"])

        return run

    def add(table: pa.Table) -> pa.Table:
        s = matrix(table["sums"], dim).sum(axis=0)
        return pa.table({"cell": table["cell"][:1], "n": [float(np.sum(table["n"].to_numpy()))], "sums": pa.array([s])})

    def totals(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        schema = "cell long, n double, sums array<double>"
        got = points.mapInArrow(sums(centres), schema).groupBy("cell").applyInArrow(add, schema).toArrow()
        n, s = np.zeros(len(centres)), np.zeros((len(centres), dim))
        cell = got["cell"].to_numpy()
        if len(cell):
            n[cell], s[cell] = got["n"].to_numpy(), matrix(got["sums"], dim)
        return n, s

    def drawn(centres: np.ndarray, salt: int) -> np.ndarray:
        got = points.mapInArrow(draw(centres, salt), "key double, vec array<float>").orderBy("key").limit(k)
        rows = got.toArrow()
        return matrix(rows["vec"], dim) if rows.num_rows else np.zeros((0, dim))

    centres = np.zeros((0, dim))
    for r in range(rounds):
        centres = np.concatenate([centres, drawn(centres, seed + r)])
    if not len(centres):
        return centres
    weight, _ = totals(centres)
    centres = _recluster(centres, weight, k, seed)
    for _ in range(passes):
        n, s = totals(centres)
        centres = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centres)
    return centres


def _recluster(c: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ over the candidates; bounded input."""
    c, weight = c[weight > 0], weight[weight > 0]
    if len(c) <= k:
        return c
    rng = np.random.default_rng(seed)
    chosen = [int(np.argmax(weight))]
    d2 = ((c - c[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and (d2 * weight).sum() > 0:
        chosen.append(int(rng.choice(len(c), p=d2 * weight / (d2 * weight).sum())))
        d2 = np.minimum(d2, ((c - c[chosen[-1]]) ** 2).sum(axis=1))
    return c[chosen]


# --------------------------------------------------------------------------------------------- cells


def cells_of(centres: np.ndarray, dim: int, margin: float, probes: int):
    """Each row with its nearest cell and up to probes - 1 others whose border is within ``margin``; core tells that it is
    within half the linking angle of the cell's centre, so that any two core rows of a cell are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = np.linalg.norm(centres, axis=1)
        for b in batches:
            if not b.num_rows:
                continue
            u = unit(matrix(b.column("vec"), dim))
            near = u @ centres.T - length**2 / 2
            few = min(probes, len(centres))
            top = np.argpartition(-near, few - 1, axis=1)[:, :few]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
            score = np.take_along_axis(near, top, 1)
            apart = np.linalg.norm(centres[top] - centres[top[:, :1]], axis=2) if few < 64 else np.sqrt(
                np.maximum(0.0, length[top] ** 2 + length[top[:, :1]] ** 2 - 2 * (centres @ centres.T)[top, top[:, :1]])
            )
            border = (score[:, :1] - score) / np.maximum(apart, 1e-12)
            keep = border <= margin
            keep[:, 0] = True
            row, at = np.nonzero(keep)
            cell = top[row, at]
            toward = (near[row, cell] + length[cell] ** 2 / 2) / np.maximum(length[cell], 1e-12)
            core = toward >= np.sqrt((1 + b.column("cut").to_numpy()[row]) / 2) + 1e-7
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(taken) for c in b.columns), pa.array(cell.astype(np.int64)), pa.array(core)], [*b.schema.names, "cell", "core"]
            )

    return run


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each row's smallest fellow) after the links i - j."""
    a, b = label[i], label[j]
    differ = a != b
    if not differ.any():
        return label
    pairs = np.unique(np.stack([np.minimum(a, b)[differ], np.maximum(a, b)[differ]]), axis=1)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for x, y in pairs.T.tolist():
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    moved = np.arange(len(label))
    for x in up:
        moved[x] = root(x)
    return moved[label]


def local_components(u: np.ndarray, limit: float, asks: np.ndarray | None = None, core: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each row's component under cosines of ``limit`` or more among the unit rows of ``u``; -1 for
    rows without a link. Only rows that ask are compared with all others; ``core`` rows are known to be linked with each
    other and need not ask. Never holds more than a block of the similarities, nor all links of a dense group."""
    n = len(u)
    small = np.ascontiguousarray(u.astype(np.float32))
    asks = np.ones(n, bool) if asks is None else asks
    label = np.arange(n)
    linked = np.zeros(n, bool)
    if core is not None and core.sum() > 1:
        label[core] = np.flatnonzero(core)[0]
        linked |= core
        asks = asks & ~core
    asking = np.flatnonzero(asks)
    step = max(1, 4_000_000 // max(1, n))
    for s in range(0, len(asking), step):
        rows = asking[s : s + step]
        sim = small[rows] @ small.T
        sim[np.arange(len(rows)), rows] = -2.0
        near = sim >= limit - SLACK
        doubt = np.flatnonzero((near & (sim < limit + SLACK)).ravel())
        if len(doubt):
            i, j = np.divmod(doubt, n)
            near.ravel()[doubt] = cosines(u, rows[i], j) >= limit
        some = near.any(axis=1)
        linked[rows[some]] = True
        linked |= near.any(axis=0)
        label = _joined(label, rows[some], near[some].argmax(axis=1))  # most of a dense group is joined by this
        i, j = np.nonzero(near & (label[rows][:, None] != label[None, :]))
        label = _joined(label, rows[i], j)
    return np.where(linked, label, -1)


def similarity_links(
    points: DataFrame, dim: int, cell_rows: int = 1024, block_rows: int = 8192, margin: float = 0.16,
    probes: int = 6, max_cells: int = 4096, exact: bool = False,
) -> DataFrame:
    """(part, rep, hub): links that join the rows of ``points`` (part, rep, vec, cut; distinct vectors within a part)
    into the components of "cosine >= cut" of each part. At most one link per row and task leaves a cell, however
    dense it is.

    Two linked rows are compared if they have a cell in common. With ``exact`` they always have: the point midway between
    them is within sqrt(2 - 2 cut) / 2 of both, so each row goes to every cell whose border is that near (21 cells a row
    rather than 3 on the test tables, which costs as much more). Otherwise rows go to cells within ``margin``, ``probes``
    at most, which loses few links and, as components have many, fewer rows.

    Rows within half the linking angle of a cell's centre are linked to one hub at once. Only the others ask: in a cell of
    more than block_rows rows, blocks of those that ask meet blocks of all rows, so a tight group of any size costs in
    proportion to its rows, and no task holds more than two blocks."""
    total = points.count()
    centres = kmeans(points, dim, max(1, min(max_cells, total // cell_rows)))
    if not len(centres):
        return points.select("part", "rep", F.col("rep").alias("hub")).limit(0)
    if exact:
        least = points.agg(F.min("cut")).first()[0]
        margin, probes = math.sqrt(max(0.0, 2 - 2 * least)) / 2 + 1e-6, len(centres)
    shape = "part long, rep long, vec array<float>, cut double, cell long, core boolean"
    placed = points.select("part", "rep", "vec", "cut").mapInArrow(cells_of(centres, dim, margin, probes), shape)
    sizes = placed.groupBy("part", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("core")).alias("asking"), F.min(F.when(F.col("core"), F.col("rep"))).alias("hub")
    ).where(f"n > {block_rows}")
    blocks = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    sizes = sizes.select("part", "cell", blocks("n").alias("parts"), blocks("asking").alias("askers"), "hub")
    placed = placed.join(sizes, ["part", "cell"], "left")
    large, asker = F.col("parts").isNotNull(), ~F.col("core")
    mine = F.pmod(F.xxhash64("rep"), F.greatest(F.col("askers"), F.lit(1))).cast("int")
    theirs = F.pmod(F.xxhash64(F.lit(1), "rep"), "parts").cast("int")
    none = F.expr("cast(array() as array<int>)")
    to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(none)
    place = lambda a, b, asks: F.struct(a.alias("a"), b.alias("b"), asks.alias("asks"))
    meets = F.array_distinct(F.concat(
        F.transform(F.when(asker, to("parts")).otherwise(none), lambda j: place(mine, j, F.lit(True))),
        F.transform(to("askers"), lambda i: place(i, theirs, asker & (i == mine))),
    ))
    alone = F.array(place(F.lit(0), F.when(large, theirs).otherwise(0), asker))
    every = F.when(large & (F.col("askers") > 0), meets).otherwise(alone)
    met = placed.select("part", "rep", "vec", "cut", "cell", "core", "hub", F.explode(every).alias("p"))
    met = met.select("part", "rep", "vec", "cut", "cell", "core", "hub", "p.*")

    def join(table: pa.Table) -> pa.Table:
        rep = table["rep"].to_numpy()
        o = np.argsort(rep, kind="stable")
        rep = rep[o]
        asks, core = (table[c].to_numpy()[o].astype(bool) for c in ("asks", "core"))
        label = local_components(unit(matrix(table["vec"], dim)[o]), float(table["cut"][0].as_py()), asks, core)
        at = np.flatnonzero(label >= 0)
        ends, hubs = rep[at], rep[label[at]]
        if table["hub"].null_count < len(rep):  # of a large cell; all tasks name the same hub of its core
            ends = np.r_[ends, rep[core]]
            hubs = np.r_[hubs, np.full(core.sum(), table["hub"].drop_null()[0].as_py(), np.int64)]
        part = np.full(len(ends), table["part"][0].as_py(), dtype=np.int64)
        return pa.table({"part": part, "rep": pa.array(ends), "hub": pa.array(hubs)})

    return met.groupBy("part", "cell", "a", "b").applyInArrow(join, "part long, rep long, hub long")


def clusters(
    df: DataFrame, id_col: str, vec_col: str, dim: int, limit: float = 0.85, least: int = 3, **tuning
) -> tuple[DataFrame, DataFrame]:
    """(members, points). members: id, cluster (its smallest id), size, rep; rows joined by chains of cosines of
    ``limit`` or more, clusters of ``least`` rows or more. points: rep, vec of the distinct vectors.

    Ids stand for one vector each; equal rows repeated under one id count once. Null ids, null, empty, zero and
    non-finite vectors and such of another length are in no cluster; exact copies are collapsed before and expanded after the search; an empty table gives empty results;
    extra columns are ignored.
    """
    scratch = Scratch(df.sparkSession)
    plain, rows = distinct_vectors(df, id_col, vec_col, dim)
    classes = scratch.keep(plain)
    points = classes.select(F.lit(0).cast("long").alias("part"), "rep", "vec", F.lit(limit).alias("cut"))
    links = scratch.keep(similarity_links(points, dim, **tuning))
    labels = connected_components(links, "rep", "hub").withColumnRenamed("node", "rep")
    joined = rows.distinct().join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select("id", "rep")
    tagged = joined.join(labels, "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("cluster"))
    tagged = scratch.keep(tagged)
    sizes = tagged.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return tagged.join(sizes, "cluster").select("id", "cluster", "size", "rep"), classes.select("rep", "vec")


def typical_members(members: DataFrame, points: DataFrame, dim: int, top: int = 3) -> DataFrame:
    """(cluster, size, rank, id, cosine): the ``top`` members nearest each cluster's centroid, ties by id.

    Sums of vectors are taken per Arrow batch before they are shuffled, and members are ranked in two salted stages,
    so a cluster with a third of all rows is no task of its own."""
    rows = members.join(points, "rep").select("id", "cluster", "size", "vec")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key, at = np.unique(b.column("cluster").to_numpy(), return_inverse=True)
                s = np.zeros((len(key), dim))
                np.add.at(s, at, unit(matrix(b.column("vec"), dim)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(key) * dim + 1, dim, dtype=np.int32)), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(key), flat], ["cluster", "sums"])

    def whole(table: pa.Table) -> pa.Table:
        s = matrix(table["sums"], dim).sum(axis=0)
        return pa.table({"cluster": table["cluster"][:1], "centroid": pa.array([s / (np.linalg.norm(s) or 1.0)])})

    centroids = (
        rows.select("cluster", "vec").mapInArrow(part, "cluster long, sums array<double>")
        .groupBy("cluster").applyInArrow(whole, "cluster long, centroid array<double>")
    )
    dot = F.aggregate(F.zip_with("vec", "centroid", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scored = rows.join(centroids, "cluster").select("cluster", "size", "id", F.round(dot / norm, 6).alias("cosine"))
    order = [F.desc("cosine"), "id"]
    salted = Window.partitionBy("cluster", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(*order)
    final = Window.partitionBy("cluster").orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top)


# --------------------------------------------------------------------------------------------- queries


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/document_features.parquet").select("feature_id", "embedding")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_key, feature_id): rows in clusters of at least three rows."""
    members, _ = clusters(_files(spark, sf_dir), "feature_id", "embedding", dim=64, limit=0.85, least=3)
    return members.select(F.col("cluster").alias("cluster_key"), F.col("id").alias("feature_id"))


def p1_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size and its three most typical members."""
    members, points = clusters(_files(spark, sf_dir), "feature_id", "embedding", dim=64, limit=0.85, least=3)
    return typical_members(members, points, 64).select(
        F.col("cluster").alias("cluster_key"), "size", "rank", F.col("id").alias("feature_id"), "cosine"
    )


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groupings of the training sessions against the clusters: for each burst of a session's last save, and for its
    single files (burst_no -1), the files that have a cluster or stand alone, and over how many clusters they are spread;
    files without a usable embedding and files that are no documents have none."""
    files = spark.read.parquet(f"{sf_dir}/document_features.parquet").select("feature_id", "path", "embedding")
    members, _ = clusters(files, "feature_id", "embedding", dim=64, limit=0.85, least=1)
    by_path = files.select("feature_id", "path").join(members.select(F.col("id").alias("feature_id"), "cluster"), "feature_id")
    by_path = by_path.select("path", "cluster").distinct()
    newest = F.max_by(F.struct("bursts", "singletons"), "updated_at").alias("s")
    last = spark.read.parquet(f"{sf_dir}/training_sessions.parquet").groupBy("session_id").agg(newest)
    bursts = last.select("session_id", F.posexplode("s.bursts").alias("burst_no", "files"))
    single = last.select("session_id", F.lit(-1).alias("burst_no"), F.col("s.singletons").alias("files"))
    listed = bursts.unionByName(single).select("session_id", "burst_no", F.explode("files").alias("path")).distinct()
    return listed.join(by_path, "path").groupBy("session_id", "burst_no").agg(
        F.count_distinct("path").alias("files"), F.count_distinct("cluster").alias("clusters")
    )
