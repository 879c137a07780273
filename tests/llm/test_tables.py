"""Problems 4, 5 and 8 against brute force, and their edge cases."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import mixing, pairwise, topn

RESULTS = "result_id long, item_id long, burst_id string, score int, local_rank int, judged_at timestamp, loaded_at timestamp, rank int"
AT = datetime(2024, 1, 1)


def _results(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        burst = rng.choice([None, "hot", "hot", *(f"b{k}" for k in range(60))])
        when = rng.choice([None, AT, AT + timedelta(days=rng.randint(0, 3))])
        rows.append((i, rng.choice([None, *range(400)]), burst, rng.choice([None, *range(-1, 8)]), rng.choice([None, 1, 2, 3]), when, AT, 7))
    return rows + [(*r[:6], AT + timedelta(days=1), 7) for r in rows[:100]]


def _expected(rows, n):
    last, out = {}, {}
    for rid, item, burst, score, rank, at, _, _ in rows:
        if burst is None or item is None:
            continue
        key = (at is not None, at or AT, rid)
        if (burst, item) not in last or key > last[burst, item][0]:
            last[burst, item] = (key, score, rank)
    for (burst, item), (_, score, rank) in last.items():
        if score is not None:
            out.setdefault(burst, []).append((-min(5, max(1, score)), rank is None, rank or 0, item))
    return {b: [x[-1] for x in sorted(v)[:n]] for b, v in out.items()}


@pytest.mark.parametrize("n", [1, 3, 500])
def test_best_of_bursts(spark, n):
    rows = _results()
    got = {}
    for r in topn.best_of_bursts(spark.createDataFrame(rows, RESULTS), n).collect():
        got.setdefault(r["burst_id"], {})[r["rank"]] = r["item_id"]
    assert {b: [v[k] for k in sorted(v)] for b, v in got.items()} == _expected(rows, n)
    assert topn.best_of_bursts(spark.createDataFrame([], RESULTS), n).count() == 0


def test_top_n_keeps_columns_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 5.0, "x"), (None, 2, 5.0, None), ("a", 3, None, "y"), ("a", 4, 1.0, "z")], "g string, i int, s double, text string")
    got = topn.top_n(df, ["g"], "i", [F.col("s").desc_nulls_last()], 1).collect()
    assert {(r["g"], r["i"], r["rank"]) for r in got} == {(None, 1, 1), ("a", 4, 1)} and "text" in got[0]


# ------------------------------------------------------------------------------------------------ pairwise

PAIRS = "pair_id long, photo_a string, photo_b string, choice string, comparison_type string, weight double, loaded_at timestamp, item string, x int"


def _duels(n=2500, items=60, seed=5):
    rng = random.Random(seed)
    strength = {f"p{i:02d}": rng.gauss(0, 1.2) for i in range(items)}
    rows = []
    for k in range(n):
        a, b = rng.sample(sorted(strength), 2)
        eta = strength[a] - strength[b] + 0.4
        up, tie = math.exp(eta / 2), math.exp(-1.0)
        x = rng.random() * (up + 1 / up + tie)
        choice = rng.choice(["left", " LEFT "]) if x < up else rng.choice(["right", "Right"]) if x < up + 1 / up else rng.choice(["both", "neither"])
        rows.append((k, a, b, choice, "within_burst", None if k % 40 == 0 else 1.0, AT, "clash", 1))
    return strength, rows


def _reference(rows, penalty):
    """Newton with dense matrices over all strengths and both parameters."""
    names = sorted({r[i] for r in rows for i in (1, 2)})
    at, k = {n: i for i, n in enumerate(names)}, len({r[i] for r in rows for i in (1, 2)})
    z = np.zeros(k + 2)
    for _ in range(60):
        g, h = -penalty * np.r_[z[:k], 0, 0], penalty * np.diag(np.r_[np.ones(k), 0, 0])
        for _, a, b, c, _, w, *_ in rows:
            w = 2.0 if w is None else w
            e = np.zeros(k + 2)
            e[at[a]], e[at[b]], e[k] = 1, -1, 1
            d = np.eye(k + 2)[k + 1]
            weights = np.exp([e @ z / 2, -(e @ z) / 2, z[k + 1]])
            p = weights / weights.sum()
            x = np.stack([e / 2, -e / 2, d])  # what each outcome's weight depends on
            mean = p @ x
            chosen = {"left": 0, "right": 1}.get(c.strip().lower(), 2)
            g += w * (x[chosen] - mean)
            h += w * ((x * p[:, None]).T @ x - np.outer(mean, mean))
        step = np.linalg.solve(h, g)
        z = z + step
        if np.abs(step).max() < 1e-12:
            break
    return dict(zip(names, z[:k])), z[k], z[k + 1]


def test_ranking_is_the_penalised_maximum(spark):
    strength, rows = _duels()
    extra = [rows[0], (5000, "p00", "p00", "left", "within_burst", 1.0, AT, "", 1), (5001, "p00", None, "left", "", 1.0, AT, "", 1),
             (5002, "p01", "p02", "skip", "", 1.0, AT, "", 1), (5003, "p01", "p02", None, "", 1.0, AT, "", 1), (None, "p01", "p02", "left", "", 1.0, AT, "", 1)]
    df = spark.createDataFrame(rows + extra, PAIRS)
    got = {r["name"]: r for r in pairwise.ranking(df).collect()}  # production settings
    want, first, draw = _reference(rows, 0.25)
    assert set(got) == set(want) and max(abs(got[n]["strength"] - want[n]) for n in want) < 1e-6
    joined = {r["name"]: r["strength"] for r in pairwise.ranking(df, dense_items=0).collect()}
    assert set(joined) == set(want) and max(abs(joined[n] - want[n]) for n in want) < 1e-6
    _, params = pairwise.strengths(pairwise.verdicts(df, "pair_id", "photo_a", "photo_b", "choice", "weight", "comparison_type"))
    assert abs(params["first"] - first) < 1e-6 and abs(params["draw"] - draw) < 1e-6
    assert abs(first - 0.4) < 0.2 and np.corrcoef([strength[n] for n in want], [got[n]["strength"] for n in want])[0, 1] > 0.95
    decided = sum(r[3].strip().lower() in ("left", "right") for r in rows)
    assert sum(r["decided"] for r in got.values()) == 2 * decided
    with pytest.raises(RuntimeError, match="still move"):
        pairwise.ranking(df, newton=1)


def test_hot_items_are_looked_up_apart(spark):
    ends = spark.createDataFrame([(i, 7, 1.0) for i in range(12_000)] + [(7, 8, 1.0)], "item long, other long, v double")
    passes = pairwise._Passes(ends, 12_001)
    assert passes.hot == [7]
    values = spark.createDataFrame([(7, 0.5), (8, 0.25)], "item long, x double")
    got = passes.with_other(ends, values).groupBy("x").count().collect()
    assert {(r["x"], r["count"]) for r in got} == {(0.5, 12_000), (0.25, 1)}


def test_ranking_of_nothing(spark):
    assert pairwise.ranking(spark.createDataFrame([], PAIRS)).count() == 0
    skips = spark.createDataFrame([(1, "a", "b", "skip", "", 1.0, AT, "", 1)], PAIRS)
    assert pairwise.ranking(skips).count() == 0


# ------------------------------------------------------------------------------------------------ mixing

DOCS = "doc long, text string, source string, tokens int, plan string, id string"
PLANS = "plan_name string, source string, target_share double, max_repeats int, total_fraction double, cap int"


def _documents():
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        source = rng.choice(["big", "BIG", " big", "mid-size", "mid_size", "small" if i % 20 == 0 else "big", None])
        rows.append((i, " ".join(rng.choice(["alpha", "of", "mail", "x"]) for _ in range(rng.randint(1, 120))), source, 1, "p", "q"))
    return rows + [(5000, None, "big", 1, "p", "q"), (5001, "", "small", 1, "p", "q"), (5002, "<|endoftext|> word " * 5000, "mid_size", 1, "p", "q")]


def test_mixture_reaches_its_shares(spark):
    docs = spark.createDataFrame(_documents(), DOCS)
    plans = [("a", "big", 0.5, 2, 0.3, 1), ("a", "mid_size", 0.3, 4, 0.3, 1), ("a", "small", 0.1, 3, 0.3, 1), ("a", "none", 0.1, 3, 0.3, 1),
             ("b", "mid_size", 0.9, 2, 1.0, 1), ("b", "big", 0.1, 0, 1.0, 1)]
    copies, shares = mixing.mixture(docs, "doc", "text", "source", spark.createDataFrame(plans + plans[:1], PLANS))
    share = {(r["plan"], r["source"]): r for r in shares.collect()}
    rows = copies.collect()
    assert set(share) == {(p[0], p[1]) for p in plans}
    for p, s, _, most, *_ in plans:
        own = [r for r in rows if (r["plan"], r["source"]) == (p, s)]
        assert len({r["id"] for r in own}) == len(own) == share[p, s]["used"]
        assert sum(r["tokens"] * r["copies"] for r in own) == share[p, s]["tokens"]
        assert all(1 <= r["copies"] <= most for r in own)
    for key in (("a", "big"), ("a", "mid_size")):
        assert abs(share[key]["tokens"] - share[key]["target_tokens"]) <= 2 and not share[key]["short"]
    held = sum(r["tokens"] for r in mixing.count_tokens(docs.where("source in ('mid-size', 'mid_size')"), "text", "n").select(F.col("n").alias("tokens")).collect())
    assert share["b", "mid_size"]["tokens"] == min(2 * held, share["b", "mid_size"]["tokens"]) and share["b", "big"]["tokens"] == 0
    assert share["a", "none"]["short"] and share["a", "none"]["documents"] == 0


def test_mixture_of_nothing(spark):
    docs, plans = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", "big", 1.0, 2, 0.5, 1)], PLANS)
    copies, shares = mixing.mixture(docs, "doc", "text", "source", plans)
    assert copies.count() == 0 and shares.collect()[0]["tokens"] == 0
    full = spark.createDataFrame(_documents(), DOCS)
    copies, shares = mixing.mixture(full, "doc", "text", "source", plans.limit(0))
    assert copies.count() == 0 and shares.count() == 0


def test_tokens_are_those_of_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id long, text string")
    got = {r["id"]: r["tokens"] for r in mixing.count_tokens(df, "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1
