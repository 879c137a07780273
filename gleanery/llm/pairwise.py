"""Problem 5: one global ranking with strengths from uneven, contradictory pairwise comparisons.

Method: the paired-comparison likelihood with ties and an order effect. For the item shown first and the other,
with strengths s and t, the three outcomes have weights exp((s - t + g)/2), exp(-(s - t + g)/2) and exp(d): g is the
advantage of the first position, d the readiness to draw. The likelihood of the aggregated counts, less a penalty on
the squared strengths, is maximised by Newton steps in all of them at once. Each step's equations are solved by
conjugate gradients, in which every product with the Hessian is one pass over the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.ranking import global_rank
from gleanery.scratch import Scratch

_DRAWS = ("both", "neither")


def verdicts(df: DataFrame, key: str, first: str, second: str, choice: str, weight: str, kind: str) -> DataFrame:
    """(a, b, name_a, name_b, outcome, weight) of every comparison once: outcome left, right or draw.

    Deliveries of one key count once (the latest ``loaded_at`` where they differ); choices are trimmed and lower-cased;
    both and neither are draws; skips, nulls, unknown choices, missing items and items compared with themselves are
    left out. A null, negative or non-finite weight becomes 2 within a burst and 1 elsewhere. Items are keyed by a
    64-bit hash of their name."""
    c = F.lower(F.trim(F.regexp_replace(choice, r"[\s ]+", " ")))
    outcome = F.when(c.isin("left", "right"), c).when(c.isin(*_DRAWS), "draw")
    usual = F.when(F.col(kind) == "within_burst", 2.0).otherwise(1.0)
    w = F.col(weight).cast("double")
    w = F.when((w >= 0) & (w < float("inf")), w).otherwise(usual)
    one = df.select(
        F.col(key).alias("key"), F.col(first).alias("name_a"), F.col(second).alias("name_b"), outcome.alias("outcome"),
        w.alias("weight"), "loaded_at",
    ).where(F.col("key").isNotNull())
    latest = one.groupBy("key").agg(
        F.max_by(F.struct("name_a", "name_b", "outcome", "weight"), F.struct("loaded_at", "outcome", "name_a", "name_b")).alias("v")
    )
    return latest.select("v.*").where("outcome is not null and name_a <> name_b").select(
        F.xxhash64("name_a").alias("a"), F.xxhash64("name_b").alias("b"), "*"
    )


def _sum(df: DataFrame, **terms) -> dict[str, float]:
    row = df.agg(*[F.coalesce(F.sum(e), F.lit(0.0)).alias(k) for k, e in terms.items()]).first()
    return row.asDict()


def _both_ends(df: DataFrame, *swap: tuple[str, str], **columns: str) -> DataFrame:
    """Two rows for each row of df: the named columns, then the same with the columns of each pair in ``swap``
    exchanged."""
    turned = {x: y for pair in swap for x, y in (pair, pair[::-1])}
    there = F.struct(*[F.col(c).alias(k) for k, c in columns.items()])
    back = F.struct(*[F.col(turned.get(c, c)).alias(k) for k, c in columns.items()])
    return df.select(F.explode(F.array(there, back)).alias("s")).select("s.*")


class _Passes:
    """Looks up a value per item for the ends of the counts. Items with a large share of all counts (at most 400) are
    looked up by broadcast, the others by a shuffle, so no task gets all counts of one item."""

    def __init__(self, ends: DataFrame, rows: int):
        degree = ends.groupBy("other").count().where(F.col("count") > max(10_000, rows // 200))
        self.hot = [r["other"] for r in degree.limit(400).collect()]

    def with_other(self, ends: DataFrame, values: DataFrame) -> DataFrame:
        """ends joined with values (item, *) on ends.other = values.item."""
        named = values.withColumnRenamed("item", "other")
        if not self.hot:
            return ends.join(named, "other")
        hot = F.col("other").isin(self.hot)
        few = F.broadcast(named.where(hot))  # at most 400 rows
        return ends.where(~hot).join(named.where(~hot), "other").unionByName(ends.where(hot).join(few, "other"))


def _slopes(x, y, side, left, right, ties, first, draw, lib=np):
    """(lean, v, c, gd, vd, fit) of counts as seen from an end with strength x, the other end having y; side is 1 for the
    end shown first, else -1. lean: the log likelihood's slope in eta, the difference of the strengths plus the first
    one's advantage. v, c, vd: its negative second slopes in eta, eta and draw, draw. gd: its slope in draw. fit: itself.
    ``lib`` is numpy or Spark's functions."""
    eta, tie = side * (x - y) + first, math.exp(draw)
    up = lib.exp(eta / 2)
    z = up + 1 / up + tie
    p, q, e, n = up / z, 1 / (up * z), tie / z, left + right + ties
    mean, net = (p - q) / 2, (left - right) / 2
    return net - n * mean, n * ((p + q) / 4 - mean * mean), -n * mean * e, ties - n * e, n * e * (1 - e), net * eta + ties * draw - n * lib.log(z)


class _Dense:
    """The solver for a number of items that was checked: vectors are arrays of the driver, broadcast to the tasks. The
    counts lie in ranges of (item, other), so a task sums one range of the items, an item with many counts is spread
    over several tasks, nothing is shuffled, and a pass sends the driver one row an item."""

    def __init__(self, scratch: Scratch, ends: DataFrame, items: np.ndarray, penalty: float, counts: int, task_rows: int = 1_000_000):
        self.context, self.items, self.penalty = ends.sparkSession.sparkContext, items, penalty
        self.x = np.zeros(len(items))
        known = self.context.broadcast(items)
        names = ["item", "other", "side", "l", "r", "t"]

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = [pa.array(np.searchsorted(known.value, b.column(c).to_numpy()).astype(np.int32)) for c in names[:2]]
                yield pa.RecordBatch.from_arrays([*at, *(b.column(c) for c in names[2:])], names)

        shape = "item int, other int, side double, l double, r double, t double"
        ranges = max(self.context.defaultParallelism, -(-2 * counts // task_rows))
        self.ends = scratch.keep(ends.select(*names).mapInArrow(number, shape).repartitionByRange(ranges, "item", "other"))

    def _pass(self, run, *shared) -> tuple[np.ndarray, np.ndarray]:
        """run(item, other, counts, *shared) -> (terms for each end, terms summed over all). Returns both sums."""
        given = self.context.broadcast(shared)

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                item, other, *counts = (b.column(k).to_numpy() for k in range(6))
                terms, whole = run(item, other, counts, *given.value)
                at, place = np.unique(item, return_inverse=True)
                sums = np.zeros((4, len(at) + 2))
                for k, values in enumerate(terms):
                    sums[k, 2:] = np.bincount(place, values, minlength=len(at))
                for k, values in enumerate(whole):
                    sums[k % 4, k // 4] = values.sum()
                key = np.r_[-1, -2, at].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums)], ["item", "s0", "s1", "s2", "s3"])

        table = self.ends.mapInArrow(over, "item int, s0 double, s1 double, s2 double, s3 double").toArrow()
        given.destroy()
        key = table["item"].to_numpy() + 2
        out = np.stack([np.bincount(key, table[f"s{k}"].to_numpy(), minlength=len(self.items) + 2) for k in range(4)])
        return out[:, 2:], np.r_[out[:, 1], out[:, 0]]

    def evaluate(self, scale: float, first: float, draw: float) -> dict[str, float]:
        """Looks ``scale`` of the direction ahead: keeps the slopes there, returns what the parameters need."""
        self.ahead = self.x + scale * self.d if scale else self.x

        def run(item, other, counts, x):
            side = counts[0]
            own = side > 0
            lean, v, c, gd, vd, fit = _slopes(x[item], x[other], side, *counts[1:], first, draw)
            return (side * lean, v, side * v, side * c), tuple(own * y for y in (lean, v, c, gd, vd, fit))

        (lean, self.v, self.sv, self.sc), whole = self._pass(run, self.ahead)
        self.g = lean - self.penalty * self.ahead
        out = dict(zip(("g", "v", "c", "gd", "vd", "fit"), whole))
        out["fit"] -= self.penalty / 2 * float(self.ahead @ self.ahead)
        out["slope"] = float(np.abs(self.g).max(initial=0.0))
        return out

    def accept(self) -> None:
        self.x = self.ahead

    def solve(self, at: dict[str, float], first: float, draw: float, solved: float, most: int) -> tuple[float, float, float]:
        """The direction of the step, kept; its largest entry and its entries for the two parameters."""
        m = np.r_[self.v + self.penalty, max(at["v"], 1e-12), max(at["vd"], 1e-12)]
        r, d = np.r_[self.g, at["g"], at["gd"]], np.zeros(len(self.items) + 2)
        p = r / m
        rz = start = float(r @ p)

        def run(item, other, counts, x, p):
            _, v, *_ = _slopes(x[item], x[other], *counts, first, draw)
            return (v * p[other],), ()

        for _ in range(most):
            if rz <= solved**2 * start:
                break
            near, pf, pd = p[:-2], p[-2], p[-1]
            away = self._pass(run, self.x, near)[0][0]
            q = np.r_[
                m[:-2] * near - away + self.sv * pf + self.sc * pd,
                self.sv @ near + at["v"] * pf + at["c"] * pd, self.sc @ near + at["c"] * pf + at["vd"] * pd,
            ]
            alpha = rz / float(p @ q)
            d, r = d + alpha * p, r - alpha * q
            new = float(r @ (r / m))
            p, rz = r / m + new / rz * p, new
        self.d = d[:-2]
        return float(np.abs(d).max(initial=0.0)), float(d[-2]), float(d[-1])

    def result(self) -> DataFrame:
        """(item, strength), looked up where the items are."""
        found, known = self.context.broadcast(self.x), self.context.broadcast(self.items)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.searchsorted(known.value, b.column("item").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(found.value[at])], ["item", "strength"])

        return self.source.mapInArrow(look, "item long, strength double")


class _Shuffled:
    """The same solver for any number of items: vectors are tables, nothing is gathered but sums. Every product with the
    Hessian is one pass over the counts."""

    def __init__(self, scratch: Scratch, ends: DataFrame, items: DataFrame, penalty: float, counts: int):
        self.scratch, self.penalty = scratch, penalty
        self.ends = scratch.keep(ends)
        self.passes = _Passes(self.ends, 2 * counts)
        self.state = scratch.keep(items.withColumns({"x": F.lit(0.0), "d": F.lit(0.0)}))
        self.links = self.items = None

    def evaluate(self, scale: float, first: float, draw: float) -> dict[str, float]:
        self.scratch.drop(self.links, self.items)
        ahead = self.state.select("item", (F.col("x") + scale * F.col("d")).alias("x"))
        met = self.passes.with_other(self.ends, ahead.withColumnRenamed("x", "y"))
        turned = met.select(F.col("item").alias("other"), F.col("other").alias("item"), "side", "l", "r", "t", "y")
        met = self.passes.with_other(turned, ahead)  # x is now the strength of the end that was looked from
        terms = _slopes(F.col("x"), F.col("y"), F.col("side"), F.col("l"), F.col("r"), F.col("t"), first, draw, F)
        named = [e.alias(n) for e, n in zip(terms, ("lean", "v", "c", "gd", "vd", "fit"))]
        self.links = self.scratch.keep(met.select(F.col("other").alias("item"), F.col("item").alias("other"), "side", *named))
        side = F.col("side")
        per = self.links.groupBy("item").agg(
            F.sum(side * F.col("lean")).alias("lean"), F.sum("v").alias("v"), F.sum(side * F.col("v")).alias("sv"), F.sum(side * F.col("c")).alias("sc")
        )
        self.items = self.scratch.keep(ahead.join(per, "item").withColumn("g", F.col("lean") - self.penalty * F.col("x")))
        own = self.links.where(side > 0)
        out = _sum(own, g=F.col("lean"), **{n: F.col(n) for n in ("v", "c", "gd", "vd", "fit")})
        rest = self.items.agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.max(F.abs("g")).alias("slope")).first()
        out["fit"] -= self.penalty / 2 * (rest["xx"] or 0.0)
        return out | {"slope": rest["slope"] or 0.0}

    def accept(self) -> None:
        moved = self.scratch.keep(self.items.select("item", "x", F.lit(0.0).alias("d")))
        self.scratch.drop(self.state)
        self.state = moved

    def solve(self, at: dict[str, float], first: float, draw: float, solved: float, most: int) -> tuple[float, float, float]:
        m = F.col("v") + self.penalty
        now = self.scratch.keep(self.items.select("item", "x", m.alias("m"), "sv", "sc", F.col("g").alias("r"), F.lit(0.0).alias("d"), (F.col("g") / m).alias("p")))
        mf, md = max(at["v"], 1e-12), max(at["vd"], 1e-12)
        rf, rd, df, dd = at["g"], at["gd"], 0.0, 0.0
        pf, pd = rf / mf, rd / md
        rz = start = _sum(now, z=F.col("r") * F.col("p"))["z"] + rf * pf + rd * pd
        for _ in range(most):
            if rz <= solved**2 * start:
                break
            there = self.passes.with_other(self.links.select("item", "other", "v"), now.select("item", F.col("p").alias("po")))
            away = there.groupBy("item").agg(F.sum(F.col("v") * F.col("po")).alias("w"))
            q = F.col("m") * F.col("p") - F.col("w") + F.col("sv") * pf + F.col("sc") * pd
            step = self.scratch.keep(now.join(away, "item").withColumn("q", q).drop("w"))
            s = _sum(
                step, pq=F.col("p") * F.col("q"), qr=F.col("q") * F.col("r") / F.col("m"), qq=F.col("q") * F.col("q") / F.col("m"),
                f=F.col("sv") * F.col("p"), d=F.col("sc") * F.col("p"),
            )
            qf, qd = s["f"] + at["v"] * pf + at["c"] * pd, s["d"] + at["c"] * pf + at["vd"] * pd
            alpha = rz / (s["pq"] + pf * qf + pd * qd)
            new = rz - 2 * alpha * (s["qr"] + qf * rf / mf + qd * rd / md) + alpha * alpha * (s["qq"] + qf * qf / mf + qd * qd / md)
            new = max(new, 0.0)
            beta, df, dd, rf, rd = new / rz, df + alpha * pf, dd + alpha * pd, rf - alpha * qf, rd - alpha * qd
            self.scratch.drop(now)
            rest = F.col("r") - alpha * F.col("q")
            now = self.scratch.keep(step.select(
                "item", "x", "m", "sv", "sc", rest.alias("r"), (F.col("d") + alpha * F.col("p")).alias("d"),
                (rest / F.col("m") + beta * F.col("p")).alias("p"),
            ))
            self.scratch.drop(step)
            pf, pd, rz = rf / mf + beta * pf, rd / md + beta * pd, new
        ahead = self.scratch.keep(now.select("item", "x", "d"))
        self.scratch.drop(self.state, now)
        self.state = ahead
        largest = ahead.agg(F.max(F.abs("d"))).first()[0] or 0.0
        return max(largest, abs(df), abs(dd)), df, dd

    def result(self) -> DataFrame:
        return self.state.select("item", F.col("x").alias("strength"))


def strengths(
    rows: DataFrame, penalty: float = 0.25, newton: int = 60, inner: int = 500, tolerance: float = 1e-6, dense_items: int = 4_000_000
) -> tuple[DataFrame, dict[str, float]]:
    """(item, strength) for verdict rows (a, b, outcome, weight), and the parameters {first, draw, steps}.

    Strengths and both parameters step together. A step is halved until the penalised likelihood does not fall; steps
    end when what a full step leaves, at most about its size times the larger of itself and its residual, is below
    ``tolerance``, and more than ``newton`` of them raise an error. Each step's equations are
    solved to a tenth of their residual, near the maximum to a thousandth. Up to ``dense_items`` items (32 MB a vector)
    the vectors are broadcast, beyond they are joined; the result is the same.

    Strengths are centred at 0 by the penalty; an item without a decided comparison gets what its draws say. An empty
    table gives an empty result."""
    scratch = Scratch(rows.sparkSession)
    won = lambda o: F.sum(F.when(F.col("outcome") == o, F.col("weight")).otherwise(0.0))
    counts = rows.groupBy("a", "b").agg(won("left").alias("l"), won("right").alias("r"), won("draw").alias("t"))
    counts = scratch.keep(counts.withColumns({"side": F.lit(1.0), "back": F.lit(-1.0)}))
    ends = _both_ends(counts, ("a", "b"), ("side", "back"), item="a", other="b", side="side", l="l", r="r", t="t")
    items = scratch.keep(ends.select("item").distinct())
    total = _sum(counts, n=F.col("l") + F.col("r") + F.col("t"), t=F.col("t"), pairs=F.lit(1))
    if not total["pairs"]:
        return items.withColumn("strength", F.lit(0.0)), {"first": 0.0, "draw": 0.0, "steps": 0}
    if items.count() <= dense_items:
        model = _Dense(scratch, ends, np.sort(items.toArrow()["item"].to_numpy()), penalty, int(total["pairs"]))
        model.source = items
    else:
        model = _Shuffled(scratch, ends, items, penalty, int(total["pairs"]))
    first, draw = 0.0, math.log(max(total["t"], 0.5) / max(total["n"] - total["t"], 0.5))
    at = model.evaluate(0.0, first, draw)
    steepest = at["slope"]
    for done in range(1, newton + 1):
        solved = min(0.1, max(1e-3, at["slope"] / max(steepest, 1e-300)))
        largest, df, dd = model.solve(at, first, draw, solved, inner)
        scale = min(1.0, 8.0 / largest) if largest else 1.0
        while True:
            new = model.evaluate(scale, first + scale * df, draw + scale * dd)
            if new["fit"] >= at["fit"] - 1e-9 * abs(at["fit"]) or scale * largest < tolerance:
                break
            scale /= 2
        model.accept()
        first, draw, at = first + scale * df, draw + scale * dd, new
        if largest * max(largest, solved) < tolerance:
            return model.result(), {"first": first, "draw": draw, "steps": done}
    raise RuntimeError(f"strengths still move by {largest:.2g} after {newton} steps")


def ranking(
    df: DataFrame, key: str = "pair_id", first: str = "photo_a", second: str = "photo_b", choice: str = "choice",
    weight: str = "weight", kind: str = "comparison_type", **tuning,
) -> DataFrame:
    """(name, strength, compared, decided) for every item that was compared with another one; see ``verdicts`` for
    what counts, ``strengths`` for the model. Extra columns are ignored; an empty table gives an empty result."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.keep(verdicts(df, key, first, second, choice, weight, kind))
    fitted, _ = strengths(rows, **tuning)
    decided = (F.col("outcome") != "draw").cast("long")
    ends = _both_ends(
        rows.withColumn("decided", decided), ("a", "b"), ("name_a", "name_b"), item="a", name="name_a", decided="decided"
    )
    tally = ends.groupBy("item").agg(
        F.min("name").alias("name"), F.count(F.lit(1)).alias("compared"), F.sum("decided").alias("decided")
    )
    return tally.join(fitted, "item").select("name", "strength", "compared", "decided")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pairwise_comparisons.parquet")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo): the ten strongest photos with at least twelve decided comparisons."""
    ranked = ranking(_pairs(spark, sf_dir)).where("decided >= 12")
    return ranked.orderBy(F.desc(F.round("strength", 6)), "name").limit(10).select(F.col("name").alias("photo"))


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every photo with its place in the one ranking."""
    rows = ranking(_pairs(spark, sf_dir)).withColumn("strength", F.round("strength", 6))
    ranked = global_rank(rows, [F.desc("strength"), F.asc("name")])
    return ranked.select("rank", F.col("name").alias("photo"), F.round("strength", 4).alias("strength"), "compared", "decided")
