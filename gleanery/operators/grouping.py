"""Groups of items: time gaps, greedy and transitive similarity, islands, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.components import connected_components
from gleanery.operators.ordered import Ordered
from gleanery.scratch import Scratch


def capture_time(original: Column, modified: Column, name: Column, stored: Column) -> Column:
    """The first of: time of the shot, time of the edit, date in a name like IMG-20240131- (at noon), file time."""
    day = F.regexp_extract(name, r"(?i)(?:IMG|VID|AUD)-(\d{8})-", 1)
    noon = F.try_to_timestamp(F.concat(day, F.lit(" 12")), F.lit("yyyyMMdd HH"))
    return F.coalesce(original, modified, noon, stored)


def sessions(df: DataFrame, by: list[str], time: str, item: str, window_seconds: float = 10.0) -> DataFrame:
    """``df`` with group_id (the group's first item), group_index (from 0) and group_size: within each ``by``, items
    follow each other in a group while the gap to the one before is at most ``window_seconds``.

    Rows without a time are left out. ``item`` should be unique; ties in time go by item. Null keys are a key of their
    own. The order is cut into ranges, so one key with a third of all rows is no task of its own.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in by]
    held = df.where(F.col(time).isNotNull()).withColumn("__key", F.concat_ws("\x01", F.lit(""), *keys))
    held = held.withColumn("__at", F.unix_micros(F.col(time).cast("timestamp")))
    order = [F.col("__key"), F.col("__at"), F.col(item)]
    o = Ordered(held, order).position("__pos").last_before(F.struct("__key", "__at"), "__prev")
    near = (F.col("__prev.__key") == F.col("__key")) & (F.col("__at") - F.col("__prev.__at") <= int(window_seconds * 1e6))
    o = o.with_column("__start", ~F.coalesce(near, F.lit(False)))
    o = o.last_where(F.col("__start"), F.struct(F.col("__pos").alias("p"), F.col(item).alias("i")), "__head")
    rows = o.done().withColumn("group_id", F.col("__head.i")).withColumn("__first", F.col("__head.p"))
    rows = rows.withColumn("group_index", (F.col("__pos") - F.col("__first")).cast("int"))
    sizes = rows.groupBy("__first").agg(F.count(F.lit(1)).cast("int").alias("group_size"))
    out = rows.join(sizes, "__first")
    return out.drop("__key", "__at", "__pos", "__prev", "__start", "__head", "__first")


def group_statistics(groups: DataFrame, least: int = 2) -> DataFrame:
    """Number, smallest, largest, mean and total size of the groups of at least ``least`` items."""
    one = groups.where((F.col("group_index") == 0) & (F.col("group_size") >= least))
    return one.agg(
        F.count(F.lit(1)).alias("groups"), F.min("group_size").alias("smallest"), F.max("group_size").alias("largest"),
        F.avg("group_size").alias("mean"), F.sum("group_size").cast("long").alias("items"),
    )


def greedy_groups(unit: np.ndarray, limit: float) -> np.ndarray:
    """Single-pass clusters in row order: a row joins the open cluster if it is similar enough to a member that the
    cluster had when the row was looked at; rows that are passed over are not looked at again for it. Rows without a
    vector (NaN) are clusters of one."""
    label = np.full(len(unit), -1)
    for seed in range(len(unit)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        rest = seed + 1 + np.flatnonzero(label[seed + 1 :] < 0)
        if not len(rest) or np.isnan(unit[seed, 0]):
            continue
        best = unit[rest] @ unit[seed]
        at = 0
        while True:
            hits = np.flatnonzero(best[at:] >= limit)
            if not len(hits):
                break
            at += int(hits[0])
            label[rest[at]] = seed
            best = np.fmax(best, unit[rest] @ unit[rest[at]])  # only rows after this one are still looked at
            at += 1
    return label


def _joined(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``lab`` (the smallest row that each row is joined to) after the links i - j."""
    a, b = lab[i], lab[j]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
    if not pairs.shape[1]:
        return lab
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for x, y in pairs.T.tolist():
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    moved = np.arange(len(lab))
    for x in up:
        moved[x] = root(x)
    return moved[lab]


def _forest(m: np.ndarray, limit: float, split: int, rows: int = 64) -> np.ndarray:
    """The smallest row that each row is joined to by chains of cosines of ``limit`` or more; with ``split`` > 0 only those
    between rows before it and the others count."""
    lab = np.arange(len(m))
    first, other = (len(m), m) if split == 0 else (split, m[split:])
    for s in range(0, first, rows):
        i, j = np.nonzero(m[s : min(s + rows, first)] @ other.T >= limit)
        lab = _joined(lab, i + s, j + split)
    return lab


def _split(several: DataFrame, large: DataFrame, limit: float, block_rows: int) -> DataFrame:
    """``several`` (g, i, item, vec) of the groups in ``large`` (g, size, dim) with ``s``, the first index of the row's
    component of "cosine >= limit" within its group; null for a row that is like no other. The blocks of a group are
    compared pair by pair, exactly, and each pair gives a forest, so dense groups give few links; the work is quadratic
    in a group, but no task holds more than two blocks."""
    rows = several.join(F.broadcast(large), "g").withColumn("vec", F.when(F.size("vec") == F.col("dim"), F.col("vec")))
    own, blocks = F.floor(F.col("i") / block_rows).cast("int"), F.ceil(F.col("size") / block_rows).cast("int")
    usable = rows.where("vec is not null").select("g", "i", F.col("vec").cast("array<double>").alias("vec"), own.alias("own"), blocks.alias("n"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least(k, "own").alias("x"), F.greatest(k, "own").alias("y")))
    placed = usable.withColumn("p", F.explode(pairs)).select("g", "i", "vec", "own", "p.x", "p.y")
    kind = dict(several.dtypes)["g"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        vec = table["vec"].combine_chunks()
        m = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
        split = 0 if table["x"][0].as_py() == table["y"][0].as_py() else int((table["own"].to_numpy() == table["x"][0].as_py()).sum())
        if split == 0 and table["x"][0].as_py() != table["y"][0].as_py():
            split = len(table)
        lab = _forest(m, limit - 1e-6, split)  # a looser limit only joins components, which changes no cluster
        at = np.flatnonzero(lab != np.arange(len(lab)))
        i = table["i"].to_numpy()
        return pa.table({"g": table["g"].take(pa.array(at)), "a": pa.array(i[at], pa.int64()), "b": pa.array(i[lab[at]], pa.int64())})

    links = placed.groupBy("g", "x", "y").applyInArrow(run, f"g {kind}, a long, b long")
    ends = links.select(F.struct("g", F.col("a").alias("i")).alias("a"), F.struct("g", F.col("b").alias("i")).alias("b"))
    found = connected_components(ends, "a", "b").select(F.col("node.g").alias("g"), F.col("node.i").alias("i"), F.col("component.i").alias("s"))
    return rows.select("g", F.col("i").cast("long").alias("i"), "item", "vec").join(found, ["g", "i"], "left")


def similar_bursts(
    groups: DataFrame, item: str, vec: str, time: str, limit: float = 0.92, least: int = 2, most: int = 50,
    keep_tail: bool = True, max_group: int = 20_000, block_rows: int = 4096,
) -> DataFrame:
    """(item, burst_id, burst_index, burst_size) for the rows of ``sessions``: every temporal group is clustered greedily
    by similarity in time order, clusters are cut into slices of ``most``, and what is smaller than ``least`` becomes
    single items. A tail slice below ``least`` is kept as single items, or dropped with keep_tail=False.

    Only groups of two or more reach Python. The rule is sequential within a group, but a cluster never leaves a component
    of "cosine >= limit"; so a group of more than ``max_group`` items is clustered component by component, with the same
    result, and a task holds a component of it. Null vectors are single items.
    """
    kind = dict(groups.dtypes)[item]
    several = groups.where("group_size > 1").select(
        F.col("group_id").alias("g"), F.col("group_index").cast("long").alias("i"), F.col(item).alias("item"), F.col(vec).alias("vec")
    )
    scratch = Scratch(groups.sparkSession)
    beyond = several.where(F.col("i") >= max_group).select("g").distinct()
    large = scratch.keep(
        several.join(F.broadcast(beyond), "g").groupBy("g").agg((F.max("i") + 1).alias("size"), F.max(F.size("vec")).alias("dim"))
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        vecs = table["vec"].to_pylist()
        dim = max((len(v) for v in vecs if v), default=1)
        m = np.full((len(vecs), dim), np.nan)
        for k, v in enumerate(vecs):
            if v and len(v) == dim and None not in v:
                m[k] = v
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            m = np.where(norm > 0, m / norm, np.nan)
        label = greedy_groups(m, limit)
        order = np.argsort(label, kind="stable")
        start = np.searchsorted(label[order], label[order])
        pos = np.arange(len(order)) - start
        size = np.bincount(label, minlength=len(label))[label[order]]
        piece = pos // most
        piece_size = np.minimum(most, size - piece * most)
        single = piece_size < least
        kept = np.ones(len(order), bool) if keep_tail else ~(single & (piece > 0))
        items = table["item"].take(pa.array(order))
        firsts = np.where(single, np.arange(len(order)), start + piece * most)
        out = pa.table({
            "item": items, "burst_id": items.take(pa.array(firsts)),
            "burst_index": pa.array(np.where(single, 0, pos - piece * most).astype(np.int32)),
            "burst_size": pa.array(np.where(single, 1, piece_size).astype(np.int32)),
        })
        return out.filter(pa.array(kept))

    shape = f"item {kind}, burst_id {kind}, burst_index int, burst_size int"
    alone = groups.where("group_size = 1").select(F.col(item).alias("item"))
    whole = several.withColumn("s", F.lit(0).cast("long"))
    if not large.isEmpty():
        split = scratch.keep(_split(several, large, limit, block_rows))
        alone = alone.union(split.where("s is null").select("item"))
        rest = whole.join(F.broadcast(large.select("g")), "g", "left_anti").select("g", "s", "i", "item", "vec")
        whole = rest.unionByName(split.where("s is not null").select("g", "s", "i", "item", "vec"))
    found = whole.groupBy("g", "s").applyInArrow(run, shape)
    return found.unionByName(alone.select("item", F.col("item").alias("burst_id"), F.lit(0).alias("burst_index"), F.lit(1).alias("burst_size")))


def _usable(df: DataFrame, item: str, vec: str, dim: int) -> DataFrame:
    """(id, vec) without null, zero, non-finite and odd-length vectors; floats stay floats."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kind = "array<float>" if dict(df.dtypes)[vec] == "array<float>" else "array<double>"
    return df.where(F.col(vec).isNotNull() & (F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0)).select(
        F.col(item).cast("long").alias("id"), F.col(vec).cast(kind).alias("vec")
    )


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # keeps huge values finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _drawn(rows: DataFrame, total: int, wanted: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of up to ``wanted`` of the ``total`` rows, chosen by hash."""
    share = min(1_000_000, 2 * wanted * 1_000_000 // max(total, 1) + 1)
    got = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).limit(wanted).toArrow()
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    return got["id"].to_numpy(), _unit(got["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim))


def _pivots(rows: DataFrame, total: int, dim: int, cell_rows: int, most_cells: int) -> np.ndarray:
    return np.unique(_drawn(rows, total, max(1, min(most_cells, total // cell_rows)), dim)[1], axis=0)


def _near_cells(u: np.ndarray, pivots: np.ndarray, limit: float) -> np.ndarray:
    """(row, cell): the border of the cell is within half the limit's distance of the row."""
    margin = float(np.sqrt(max(0.0, 2 - 2 * limit))) / 2 + 1e-6
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))
    near = u @ pivots.T
    return near.max(axis=1)[:, None] - near <= margin * apart[near.argmax(axis=1)]


def _placed(rows: DataFrame, pivots: np.ndarray, dim: int, limit: float, block_rows: int) -> DataFrame:
    """(id, vec, own, cell, x, y) of the usable rows (unit vectors): every pair with a cosine of ``limit`` or more has a
    (cell, x, y) in common.

    Cells are those of the pivots, rows chosen by hash. A row goes to every cell whose border is within
    half the limit's distance: the point midway between two similar rows is that near to both, so its cell holds both,
    and nothing is lost. Limits near 1 need few cells a row; low ones need many, and in the end compare all rows. A cell of
    more than block_rows rows is divided by a hash and treated pair of blocks (x, y) by pair of blocks."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(b.column("vec").flatten().to_numpy().reshape(-1, dim))
            row, cell = np.nonzero(_near_cells(u, pivots, limit))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(row) * dim + 1, dim, dtype=np.int32)), pa.array(u[row].ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), flat, pa.array(cell)], ["id", "vec", "cell"])

    alone = rows.select("id", F.col("vec").cast("array<double>").alias("vec"), F.lit(0).cast("long").alias("cell"))
    placed = rows.mapInArrow(place, "id long, vec array<double>, cell long") if len(pivots) > 1 else alone
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))  # one row a cell
    placed = placed.join(F.broadcast(sizes), "cell").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "own").alias("x"), F.greatest(k, "own").alias("y")))
    return placed.withColumn("p", F.explode(pairs)).select("id", "vec", "own", "cell", "p.x", "p.y")


class _Hubs:
    """Rows that many of a sample are near to, with what is known of their components from it.

    A row is of a hub's ball if it is within half the limit's angle of it. It then is of the hub's component, and rows
    further than one and a half angles from the hub are like none of the ball. A row between that is not linked to the
    hub's component asks the ball. Hubs that so many rows ask that it would cost more than their ball saves are none."""

    def __init__(self, ids: np.ndarray, u: np.ndarray, limit: float, total: int, block_rows: int, least: int = 3):
        self.limit = limit
        angle = float(np.arccos(np.clip(limit - 1e-9, -1, 1)))
        self.ball = float(np.cos(angle / 2))
        self.far = float(np.cos(min(np.pi, 1.5 * angle))) - 1e-7 if 1.5 * angle < np.pi else -2.0
        small = u.astype(np.float32)
        near = np.zeros((len(u), len(u)), bool)
        for s in range(0, len(u), 512):
            near[s : s + 512] = small[s : s + 512] @ small.T >= self.ball
        degree, chosen = near.sum(axis=1), []
        while len(degree) and degree.max() >= least:
            chosen.append(int(degree.argmax()))
            fellows = np.flatnonzero(near[chosen[-1]])
            degree = degree - near[:, fellows].sum(axis=1)
            near[:, fellows] = False
        self.ids, self.u = ids[chosen], u[chosen]
        lab = np.arange(len(chosen))
        linked = np.round(u @ self.u.T, 9) >= limit
        row, hub = np.nonzero(linked)
        if len(row):
            lab = _joined(lab, linked.argmax(axis=1)[row], hub)
        self._number(lab)
        own, _, asks = self.places(u)
        scale = max(1.0, total / max(1, len(u)))
        members = np.bincount(own[own >= 0], minlength=len(lab)) * scale
        asking = np.bincount(asks[1], minlength=len(lab)) * scale
        cost = members * np.ceil(asking / block_rows) + asking * np.ceil(members / block_rows)
        kept = np.flatnonzero(cost <= 3 * members)
        self.ids, self.u = self.ids[kept], self.u[kept]
        self._number(self.part[kept])

    def _number(self, lab: np.ndarray) -> None:
        """Puts the hubs in the order of their components, numbered from 0."""
        order = np.argsort(lab, kind="stable")
        self.ids, self.u = self.ids[order], self.u[order]
        _, self.first, self.part = np.unique(lab[order], return_index=True, return_inverse=True)
        self.head = self.ids[self.first]

    def places(self, u: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Each row's ball (-1: none), the (row, component) linked, and the (row, hub) where the row asks the ball."""
        own, links, asks = np.full(len(u), -1), [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
        for s in range(0, len(u) if len(self.u) else 0, 2048):
            near = u[s : s + 2048] @ self.u.T
            linked = np.round(near, 9) >= self.limit
            at = near.argmax(axis=1)
            every = np.arange(len(at))
            own[s : s + len(at)] = np.where((near[every, at] >= self.ball) & linked[every, at], at, -1)
            known = np.logical_or.reduceat(linked, self.first, axis=1)
            for to, hits in ((links, known), (asks, (near >= self.far) & ~known[:, self.part])):
                row, other = np.nonzero(hits)
                to.append(np.stack([row + s, other]))
        return own, tuple(np.concatenate(links, axis=1)), tuple(np.concatenate(asks, axis=1))


def _asked(table: pa.Table, dim: int, limit: float, slack: float) -> np.ndarray:
    """The ids of the asking rows that are like any of the others."""
    asks, ids = table["asks"].to_numpy(), table["id"].to_numpy()
    u = _unit(table["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
    own, ball = np.flatnonzero(asks), np.flatnonzero(~asks)
    small, found = u.astype(np.float32), np.zeros(len(own), bool)
    for s in range(0, len(own) if len(ball) else 0, 512):
        near = small[own[s : s + 512]] @ small[ball].T
        sure = near.max(axis=1) >= limit + slack
        i, j = np.nonzero((near >= limit - slack) & ~sure[:, None])
        sure[i[np.round(np.einsum("ij,ij->i", u[own[s + i]], u[ball[j]]), 9) >= limit]] = True
        found[s : s + len(sure)] = sure
    return ids[own[found]]


def _apart_links(rows: DataFrame, drawn: tuple[np.ndarray, np.ndarray], total: int, dim: int, limit: float, block_rows: int) -> DataFrame:
    """(a, b) that join the usable rows (id, vec) into the components of "cosine >= limit", exactly, for limits at which
    rows would have to go to many cells.

    Rows in the ball of a hub are done, but for the few rows that ask it. The others are compared with each other: they
    are written once, in blocks, and pairs of blocks are read, not shuffled, so the disk holds each row once whatever
    the limit is. The work is quadratic in the rows that are in no ball: single precision, and doubles next to the limit.
    A task gives one link a row at most, over all its blocks."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    kind = dict(rows.dtypes)["vec"]
    number = np.float32 if kind == "array<float>" else np.float64
    slack = (dim + 4) * 6e-8  # more than a product of single-precision unit vectors can be off
    hubs = _Hubs(*drawn, limit, total, block_rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))

        for b in batches:
            if b.num_rows:
                own, links, asks = hubs.places(_unit(b.column("vec").flatten().to_numpy().reshape(-1, dim)))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(own.astype(np.int32)), *(listed(*x, b.num_rows) for x in (links, asks))], [*b.schema.names, "own", "parts", "asks"]
                )

    placed = scratch.keep(rows.select("id", "vec").mapInArrow(place, f"id long, vec {kind}, own int, parts array<int>, asks array<int>"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, []

        def packed(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            vec = t["vec"].combine_chunks().flatten().to_numpy().astype(number)
            data = [t["id"].to_numpy().astype(np.int64).tobytes(), t["tag"].to_numpy().astype(np.int32).tobytes(), vec.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([d], pa.binary()) for d in data)], ["block", "ids", "tags", "vecs"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < block_rows:
                continue
            t = pa.Table.from_batches(held)
            while len(t) >= block_rows:
                yield packed(t.slice(0, block_rows))
                t, block = t.slice(block_rows), block + 1
            held = t.to_batches()
        if sum(x.num_rows for x in held):
            yield packed(pa.Table.from_batches(held))

    left = placed.where("own < 0").select("id", "vec", F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit(-1)).alias("tag"))
    blocks = scratch.keep(left.mapInArrow(pack, "block long, ids binary, tags binary, vecs binary"))
    x, y = blocks.toDF("x", "ids_x", "tags_x", "vecs_x"), blocks.toDF("y", "ids_y", "tags_y", "vecs_y")
    one_way = (F.col("x") < F.col("y")) == (F.xxhash64(F.least("x", "y"), F.greatest("x", "y")) % 2 == 0)  # spreads the pairs over the tasks
    pairs = x.join(y.hint("shuffle_replicate_nl"), (F.col("x") == F.col("y")) | ((F.col("x") != F.col("y")) & one_way))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab, ids, start, tagged = np.zeros(0, np.int64), [], {}, np.full(len(hubs.head), -1)
        u_x, at_x = np.zeros((0, dim)), None

        def met(b: pa.RecordBatch, r: int, side: str) -> int:
            """Where the rows of a block begin among those of the task."""
            nonlocal lab
            block = b.column(side)[r].as_py()
            if block not in start:
                start[block] = len(lab)
                ids.append(np.frombuffer(b.column(f"ids_{side}")[r].as_buffer(), np.int64).copy())
                tags = np.frombuffer(b.column(f"tags_{side}")[r].as_buffer(), np.int32)
                lab = np.concatenate([lab, len(lab) + np.arange(len(tags))])
                for tag in np.unique(tags[tags >= 0]):
                    own = start[block] + np.flatnonzero(tags == tag)
                    if tagged[tag] < 0:
                        tagged[tag] = own[0]
                    lab[own] = lab[tagged[tag]]
            return start[block]

        def vectors(b: pa.RecordBatch, r: int, side: str) -> np.ndarray:
            return _unit(np.frombuffer(b.column(f"vecs_{side}")[r].as_buffer(), number).reshape(-1, dim))

        for b in batches:
            for r in range(b.num_rows):
                x, y = met(b, r, "x"), met(b, r, "y")
                if at_x != x:
                    u_x, at_x = vectors(b, r, "x"), x
                    small_x = u_x.astype(np.float32)
                u_y = u_x if x == y else vectors(b, r, "y")
                other = np.ascontiguousarray(u_y.astype(np.float32).T)
                for s in range(0, len(u_x), 512):
                    near = small_x[s : s + 512] @ other
                    hit = near >= limit - slack
                    if x == y:
                        hit = np.triu(hit, s + 1)
                    if np.count_nonzero(hit) > 8 * len(other.T):  # a dense group, most of which is joined already
                        hit &= lab[x + s : x + s + len(hit), None] != lab[None, y : y + len(u_y)]
                    i, j = np.divmod(np.flatnonzero(hit), len(u_y))  # far faster than nonzero of a matrix of few hits
                    doubt = np.flatnonzero(near[i, j] < limit + slack)
                    if len(doubt):
                        sure = np.ones(len(i), bool)
                        sure[doubt] = np.round(np.einsum("ij,ij->i", u_x[s + i[doubt]], u_y[j[doubt]]), 9) >= limit
                        i, j = i[sure], j[sure]
                    if len(i):
                        lab = _joined(lab, x + s + i, y + j)
        at = np.flatnonzero(lab != np.arange(len(lab)))
        if len(at):
            every = np.concatenate(ids)
            yield pa.RecordBatch.from_arrays([pa.array(every[at]), pa.array(every[lab[at]])], ["a", "b"])

    links = pairs.mapInArrow(meet, "a long, b long")
    if not len(hubs.ids):
        return links
    known = spark.createDataFrame(pa.table({"part": np.arange(len(hubs.head), dtype=np.int32), "head": hubs.head}))
    own = spark.createDataFrame(pa.table({"a": hubs.ids, "b": hubs.head[hubs.part]}))
    linked = placed.select("id", F.explode("parts").alias("part")).join(F.broadcast(known), "part").select(F.col("id").alias("a"), F.col("head").alias("b"))
    links = links.unionByName(own).unionByName(linked)
    asking = placed.select("id", "vec", F.explode("asks").alias("own"))
    counts = asking.groupBy("own").agg(F.count(F.lit(1)).alias("n"))
    sizes = placed.join(F.broadcast(counts), "own").groupBy("own").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    sizes = scratch.keep(sizes.select("own", *(F.ceil(F.col(c) / block_rows).cast("int").alias(c) for c in "mn")))  # one row a hub
    if sizes.isEmpty():
        return links
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c: F.pmod(F.xxhash64("id"), c).cast("int")
    ask = asking.join(F.broadcast(sizes), "own").select("id", "vec", "own", part("n").alias("x"), every("m").alias("y"), F.lit(True).alias("asks"))
    ball = placed.join(F.broadcast(sizes), "own").select("id", "vec", "own", every("n").alias("x"), part("m").alias("y"), F.lit(False).alias("asks"))

    def answer(table: pa.Table) -> pa.Table:
        found = _asked(table, dim, limit, slack)
        head = hubs.head[hubs.part[table["own"][0].as_py()]]
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array(np.full(len(found), head), pa.int64())})

    return links.unionByName(ask.unionByName(ball).groupBy("own", "x", "y").applyInArrow(answer, "a long, b long"))


def _block(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, unit vectors, split): the rows of a block or, of two blocks, those of the first before those of the second,
    which begin at ``split``; 0 for one block."""
    table = table.sort_by([("own", "ascending"), ("id", "ascending")]).combine_chunks()
    m = table["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    own, across = table["own"].to_numpy(), table["x"][0].as_py() != table["y"][0].as_py()
    return table["id"].to_numpy(), m / np.linalg.norm(m, axis=1, keepdims=True), int((own == table["x"][0].as_py()).sum()) if across else 0


def similar_pairs(
    df: DataFrame, item: str, vec: str, dim: int, limit: float, block_rows: int = 4096, cell_rows: int = 4096, most_cells: int = 1024
) -> DataFrame:
    """(a, b, cosine) of all pairs a < b with a cosine (rounded to 9 decimals) of ``limit`` or more, each once, exactly.
    Null, zero, non-finite or odd-length vectors are in no pair. Items are unique numbers."""

    def run(table: pa.Table) -> pa.Table:
        across = table["x"][0].as_py() != table["y"][0].as_py()
        ids, m, split = _block(table, dim)
        a, b, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        first, other = (split, m[split:]) if across else (len(ids), m)
        for s in range(0, first, 512):
            i, j = np.nonzero(m[s : min(s + 512, first)] @ other.T >= limit - 1e-9)
            i, j = i + s, j + (split if across else 0)
            ok = i != j if across else i < j
            i, j = i[ok], j[ok]
            exact = np.round(np.einsum("ij,ij->i", m[i], m[j]), 9)
            ok = exact >= limit
            a.append(np.minimum(ids[i], ids[j])[ok])
            b.append(np.maximum(ids[i], ids[j])[ok])
            c.append(exact[ok])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "cosine": np.concatenate(c)})

    rows = _usable(df, item, vec, dim)
    met = _placed(rows, _pivots(rows, rows.count(), dim, cell_rows, most_cells), dim, limit, block_rows)
    return met.groupBy("cell", "x", "y").applyInArrow(run, "a long, b long, cosine double").dropDuplicates(["a", "b"])


def similarity_components(
    df: DataFrame, item: str, vec: str, dim: int, limit: float = 0.85, block_rows: int = 4096, cell_rows: int = 4096, most_cells: int = 1024,
    most_places: float = 2.0,
) -> DataFrame:
    """(item, group_id, group_size): items joined by chains of pairs with a cosine of ``limit`` or more; items without a
    usable vector are groups of one. A task gives a forest of its rows, one link a row at most, never its pairs.

    Where rows of a sample would have to go to more than ``most_places`` cells on average, nothing is sent to cells: see
    ``_apart_links``. The result is the same."""

    def run(table: pa.Table) -> pa.Table:
        across = table["x"][0].as_py() != table["y"][0].as_py()
        ids, m, split = _block(table, dim)
        if across and split in (0, len(ids)):
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        lab = _forest(m, limit - 5e-10, split)  # as rounded to 9 decimals
        at = np.flatnonzero(lab != np.arange(len(lab)))
        return pa.table({"a": ids[at], "b": ids[lab[at]]})

    rows = Scratch(df.sparkSession).keep(_usable(df, item, vec, dim))
    total = rows.count()
    pivots, drawn = _pivots(rows, total, dim, cell_rows, most_cells), None
    if len(pivots) > 1:
        drawn = _drawn(rows, total, 4096, dim)
    if drawn and _near_cells(drawn[1], pivots, limit).sum() > most_places * len(drawn[0]):
        links = _apart_links(rows, drawn, total, dim, limit, block_rows)
    else:
        links = _placed(rows, pivots, dim, limit, block_rows).groupBy("cell", "x", "y").applyInArrow(run, "a long, b long")
    found = connected_components(links, "a", "b").withColumnRenamed("node", item)
    tagged = df.select(F.col(item).cast("long").alias(item)).join(found, item, "left")
    tagged = tagged.select(item, F.coalesce("component", item).alias("group_id"))
    sizes = tagged.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return tagged.join(sizes, "group_id").select(item, "group_id", "group_size")


def nearest_of(
    vectors: DataFrame, asked: DataFrame, item: str, vec: str, dim: int, k: int, most_broadcast: int = 100_000, block_rows: int = 8192
) -> DataFrame:
    """(item, other, cosine, rank): the ``k`` most similar other vectors of every asked one, against all, exactly; ties
    (cosines rounded to 6 decimals) by the smaller item. Vectors of null, zero, non-finite or odd length are left out.

    Up to ``most_broadcast`` asked vectors are broadcast: one reading of the vectors, k rows an asked one and batch.
    Beyond, blocks of asked rows meet blocks of all rows."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = lambda d: d.where(F.col(vec).isNotNull() & (F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0)).select(
        F.col(item).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")
    )
    rows, ask = usable(vectors), usable(asked)
    shape = "q long, other long, cosine double"

    def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        m = column.flatten().to_numpy().reshape(-1, dim)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        step = max(1, 2_000_000 // max(1, len(ids)))
        for s in range(0, len(q), step):
            c = np.round(q[s : s + step] @ m.T, 6)
            c[q_ids[s : s + step, None] == ids[None, :]] = -2.0
            kth = -np.partition(-c, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            i, j = np.nonzero((c >= kth[:, None]) & (c > -2.0))
            order = np.lexsort((ids[j], -c[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            for to, values in zip(out, (q_ids[s + i[keep]], ids[j[keep]], c[i[keep], j[keep]])):
                to.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["q", "other", "cosine"])

    if ask.limit(most_broadcast + 1).count() <= most_broadcast:
        held = ask.toArrow()
        known = vectors.sparkSession.sparkContext.broadcast((held["id"].to_numpy(), unit(held["vec"]) if held.num_rows else np.zeros((0, dim))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield best(*known.value, b.column("id").to_numpy(), unit(b.column("vec")))

        found = rows.mapInArrow(scan, shape)
    else:
        m, n = (max(1, -(-d.count() // block_rows)) for d in (ask, rows))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
        part = lambda c: F.pmod(F.xxhash64("id"), F.lit(c)).cast("int")
        left = ask.select("id", "vec", part(m).alias("x"), every(n).alias("y"), F.lit(True).alias("asks"))
        right = rows.select("id", "vec", every(m).alias("x"), part(n).alias("y"), F.lit(False).alias("asks"))

        def meet(table: pa.Table) -> pa.Table:
            asks = table["asks"].to_numpy()
            ids, v = table["id"].to_numpy(), unit(table["vec"])
            if asks.all() or not asks.any():
                return pa.table({"q": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "cosine": np.zeros(0)})
            return pa.Table.from_batches([best(ids[asks], v[asks], ids[~asks], v[~asks])])

        found = left.unionByName(right).groupBy("x", "y").applyInArrow(meet, shape)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "other"))), 1, k)
    salted = found.groupBy("q", F.pmod(F.xxhash64("other"), F.lit(16))).agg(top.alias("b")).select("q", F.explode("b").alias("b"))
    lists = salted.groupBy("q").agg(F.slice(F.array_sort(F.collect_list("b")), 1, k).alias("b"))
    return lists.select(F.col("q").alias(item), F.posexplode("b").alias("r", "b")).select(
        item, "b.other", (-F.col("b.c")).alias("cosine"), (F.col("r") + 1).alias("rank")
    )


def islands(df: DataFrame, row_no: str, size: str, index: str) -> DataFrame:
    """``df`` with burst_no, counted over the row order: a new island starts where size > 1 and index = 0; a row with
    size 1 closes the island and is in none (null); null sizes are 1, null indexes -1."""
    s, i = F.coalesce(size, F.lit(1)), F.coalesce(index, F.lit(-1))
    o = Ordered(df, [F.col(row_no)]).running_sum(((s > 1) & (i == 0)).cast("long"), "__no")
    edge = (s <= 1) | ((s > 1) & (i == 0))
    o = o.last_where(edge, s > 1, "__open")
    return o.done().withColumn("burst_no", F.when((s > 1) & F.col("__open"), F.col("__no"))).drop("__no", "__open")


def chunk_ranks(df: DataFrame, position: str, rank: str, size: int = 10) -> DataFrame:
    """``df`` with chunk (position // size) and global_rank = rank + size * chunk; a null rank is the position in the
    chunk + 1."""
    chunk = F.floor(F.col(position) / size).cast("int")
    local = F.coalesce(F.col(rank), F.col(position) % size + 1)
    return df.withColumn("chunk", chunk).withColumn("global_rank", (local + chunk * size).cast("int"))


def failed_groups(df: DataFrame, burst: str, source: str) -> DataFrame:
    """``df`` with ``failed_group``: the burst, or singleton_<source> where it is null or empty."""
    return df.withColumn("failed_group", F.coalesce(F.nullif(F.col(burst), F.lit("")), F.concat(F.lit("singleton_"), F.col(source))))


def visual_groups(df: DataFrame, item: str, vec: str, limit: float = 0.92, max_group: int = 20_000) -> DataFrame:
    """(item, burst_id, burst_index, burst_size): greedy clusters over all items in the order of ``item``, for
    collections without times; more than ``max_group`` items are clustered component by component, with the same result."""
    placed = Ordered(df.select(item, vec), [F.col(item)]).position("__pos").done()
    one = placed.withColumns({"group_id": F.lit(0), "group_index": (F.col("__pos") - 1).cast("int"), "group_size": F.lit(2)})
    return similar_bursts(one, item, vec, "", limit, least=1, most=2**31 - 1, max_group=max_group)


def training_groups(images: DataFrame, videos: DataFrame, documents: DataFrame, dim: int, window: float = 10.0, limit: float = 0.8) -> DataFrame:
    """(item_id, group_id, kind) of a training session: images by time (item_id, folder, at), videos alone (item_id),
    documents by similarity (item_id, embedding)."""
    a = sessions(images, ["folder"], "at", "item_id", window).select("item_id", "group_id", F.lit("image").alias("kind"))
    untimed = images.where("at is null").select("item_id", F.col("item_id").alias("group_id"), F.lit("image").alias("kind"))
    b = videos.select("item_id", F.col("item_id").alias("group_id"), F.lit("video").alias("kind"))
    c = similarity_components(documents, "item_id", "embedding", dim, limit).select("item_id", "group_id", F.lit("document").alias("kind"))
    return a.unionByName(untimed).unionByName(b).unionByName(c)
