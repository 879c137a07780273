"""Sessions, greedy and transitive groups, islands, chunks, components, ordered scans."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import grouping
from gleanery.operators.components import connected_components
from gleanery.operators.ordered import Ordered
from gleanery.operators.ranking import global_rank

T0 = datetime(2024, 5, 1)


def _sessions(spark, seconds, window, by=None):
    rows = [(i, "k" if by is None else by[i], None if s is None else T0 + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "item int, key string, at timestamp")
    return {r["item"]: (r["group_id"], r["group_index"], r["group_size"]) for r in grouping.sessions(df, ["key"], "at", "item", window).collect()}


def test_window_is_inclusive_and_chains(spark):
    assert _sessions(spark, [0, 2, 60], 5) == {0: (0, 0, 2), 1: (0, 1, 2), 2: (2, 0, 1)}
    assert _sessions(spark, [0, 10], 10)[1] == (0, 1, 2)
    assert _sessions(spark, [0, 10.000001], 10)[1] == (1, 0, 1)
    assert _sessions(spark, [0, 10, 20, 30], 10)[3] == (0, 3, 4)
    assert _sessions(spark, [30, 0, None, 20, 10], 10) == {1: (1, 0, 4), 4: (1, 1, 4), 3: (1, 2, 4), 0: (1, 3, 4)}


def test_sessions_match_a_plain_scan(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "hot", "hot", "hot"]), rng.choice(["x", "y"]), T0 + timedelta(seconds=rng.randint(0, 3000))) for i in range(1500)]
    df = spark.createDataFrame(rows, "item int, key string, other string, at timestamp")
    got = {r["item"]: (r["group_id"], r["group_index"], r["group_size"]) for r in grouping.sessions(df, ["key", "other"], "at", "item", 3).collect()}
    want, last, group = {}, None, []

    def close():
        for k, i in enumerate(group):
            want[i] = (group[0], k, len(group))

    for i, key, other, at in sorted(rows, key=lambda r: (r[1] or "", r[2], r[3], r[0])):
        if last is None or last[:2] != (key, other) or (at - last[2]).total_seconds() > 3:
            close()
            group = []
        group.append(i)
        last = (key, other, at)
    close()
    assert got == want
    assert grouping.sessions(df.limit(0), ["key"], "at", "item", 3).count() == 0


def test_greedy_is_not_transitive():
    angles = np.radians([0, 36, 18])
    m = np.c_[np.cos(angles), np.sin(angles)]
    assert list(grouping.greedy_groups(m, 0.92)) == [0, 1, 0]
    assert list(grouping.greedy_groups(np.array([[np.nan, np.nan], [1.0, 0.0], [1.0, 0.0]]), 0.9)) == [0, 1, 1]


def _plain_greedy(m, limit):
    label = [-1] * len(m)
    for i in range(len(m)):
        if label[i] < 0:
            label[i], members = i, [i]
            for j in range(i + 1, len(m)):
                if label[j] < 0 and max(m[k] @ m[j] for k in members) >= limit:
                    label[j] = i
                    members.append(j)
    return label


def test_greedy_matches_the_plain_rule():
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = rng.standard_normal((40, 3))
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        assert list(grouping.greedy_groups(m, 0.9)) == _plain_greedy(m, 0.9)


@pytest.mark.parametrize("keep,want", [(True, 51), (False, 50)])
def test_slices_and_lost_tail(spark, keep, want):
    rows = [(i, 0, i, 51, [1.0, 0.0], T0) for i in range(51)]
    groups = spark.createDataFrame(rows, "item int, group_id int, group_index int, group_size int, vec array<double>, at timestamp")
    got = grouping.similar_bursts(groups, "item", "vec", "at", 0.92, keep_tail=keep).collect()
    assert len(got) == want and sum(r["burst_size"] == 50 for r in got) == 50
    assert sum(r["burst_size"] == 1 for r in got) == want - 50


def test_every_item_is_in_one_burst(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        n = int(rng.integers(1, 30))
        for k in range(n):
            vec = None if rng.random() < 0.1 else [float(x) for x in rng.standard_normal(4)]
            rows.append((g * 100 + k, g, k, n, vec, T0))
    groups = spark.createDataFrame(rows, "item int, group_id int, group_index int, group_size int, vec array<double>, at timestamp")
    got = grouping.similar_bursts(groups, "item", "vec", "at", 0.7, most=5).collect()
    assert sorted(r["item"] for r in got) == sorted(r[0] for r in rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r["burst_id"], []).append((r["burst_index"], r["burst_size"]))
    assert all(sorted(i for i, _ in v) == list(range(len(v))) and {s for _, s in v} == {len(v)} and len(v) <= 5 for v in sizes.values())


def test_islands(spark):
    rows = [(1, 2, 0), (2, 2, 1), (3, 2, 0), (4, 2, 1), (5, 1, -1), (6, 3, 0), (7, 3, 1), (8, 3, 2), (9, None, None), (10, 2, 1)]
    df = spark.createDataFrame(rows, "n int, size int, i int")
    got = {r["n"]: r["burst_no"] for r in grouping.islands(df, "n", "size", "i").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: None, 6: 3, 7: 3, 8: 3, 9: None, 10: None}


def test_chunk_ranks(spark):
    df = spark.createDataFrame([(i, (i % 10) + 1 if i != 3 else None) for i in range(12)], "p int, r int")
    got = {r["p"]: r["global_rank"] for r in grouping.chunk_ranks(df, "p", "r").collect()}
    assert [got[i] for i in range(12)] == [*range(1, 13)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a int, b int"), "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_similar_pairs_over_blocks(spark):
    rng = np.random.default_rng(6)
    m = rng.standard_normal((300, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    u = m.astype(float) / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.6}
    for rows_ in (4096, 50):
        got = [(r["a"], r["b"]) for r in grouping.similar_pairs(df, "id", "vec", 8, 0.6, block_rows=rows_).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    comp = {r["id"]: r["group_size"] for r in grouping.similarity_components(df, "id", "vec", 8, 0.6).collect()}
    assert comp[900] == 1 and len(comp) == 303


def test_ordered_scans(spark):
    rng = random.Random(7)
    values = [rng.choice([None, 1, 2, 3]) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").orderBy(F.rand(1))
    o = Ordered(df, [F.col("i")]).running_sum(F.col("v"), "s").last_before(F.col("v"), "p").last_where(F.col("v") == 3, F.col("i"), "w").position("pos")
    total, three = 0, None
    for k, r in enumerate(sorted(o.done().collect(), key=lambda r: r["i"])):
        total += r["v"] or 0
        three = r["i"] if r["v"] == 3 else three
        assert (r["s"], r["p"], r["w"], r["pos"]) == (total, values[k - 1] if k else None, three, k + 1)
    assert [r["rank"] for r in global_rank(df, [F.desc("i")]).orderBy(F.desc("i")).collect()] == list(range(1, 501))
    assert global_rank(df.limit(0), [F.col("i")]).count() == 0


def _vectors(n=400, dim=8, seed=9):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((25, dim))
    m = centres[np.arange(n) % 25] + 0.25 * rng.standard_normal((n, dim))
    m[7], m[11] = m[3], 5 * m[3]
    return m


@pytest.mark.parametrize("limit", [0.97, 0.9, 0.3])
def test_cells_lose_no_pair(spark, limit):
    m = _vectors()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0])]
    df = spark.createDataFrame(rows, "item long, v array<double>")
    sim = np.round(u @ u.T, 9)
    want = {(i, j) for i, j in zip(*np.nonzero(sim >= limit)) if i < j}
    tuning = dict(block_rows=16, cell_rows=20)
    got = grouping.similar_pairs(df, "item", "v", 8, limit, **tuning).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    comp = list(range(len(m)))
    for _ in range(len(m)):
        before = list(comp)
        for i, j in want:
            comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    groups = {r["item"]: r["group_id"] for r in grouping.similarity_components(df, "item", "v", 8, limit, **tuning).collect()}
    assert groups == {**dict(enumerate(comp)), 900: 900, 901: 901, 902: 902, 903: 903}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_components_of_scattered_rows_shuffle_no_copies(spark, kind):
    """At 0.8 every row is near the border of every cell: rows were shuffled once a cell."""
    rng = np.random.default_rng(12)
    near = rng.standard_normal(32)
    m = np.r_[rng.standard_normal((2600, 32)), near + 0.3 * rng.standard_normal((300, 32)), near + 0.7 * rng.standard_normal((100, 32))]
    m[5:40] = m[4] + 0.4 * rng.standard_normal((35, 32))
    m[50] = 1e3 * m[49]
    m = m.astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"id long, vec array<{kind}>")
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = sent()
    got = {r["id"]: r["group_id"] for r in grouping.similarity_components(df, "id", "vec", 32, 0.8, block_rows=500, cell_rows=100).collect()}
    assert sent() - before < 4 * m.nbytes
    assert got == dict(enumerate(_plain_components(np.round(u @ u.T, 9) >= 0.8)))


def _plain_components(linked):
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label[None, :], len(label)).min(axis=1)
        least = np.minimum(label, least)
        if (least == label).all():
            return label.tolist()
        label = least


def test_rows_ask_the_balls_they_are_near(spark):
    """Balls with rows just beyond their reach, two of them bridged by a row that is like members of both."""
    rng = np.random.default_rng(3)
    base = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    turn = lambda a, k, j: np.cos(np.radians(a)) * base[k] + np.sin(np.radians(a)) * base[j]
    rows = [turn(a, 0, 1) for a in np.linspace(0, 12, 200)]  # linked from 0 to 12 degrees
    rows += [turn(a, 0, 1) for a in np.linspace(84, 96, 200)]  # a second ball, too far from the first
    rows += [turn(48, 0, 1), turn(-40, 0, 1), turn(36, 2, 3)] + [base[k] for k in range(2, 16)]
    m = np.array(rows)
    want = _plain_components(np.round(m @ m.T, 9) >= 0.8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    hubs = grouping._Hubs(np.arange(len(m)), m, 0.8, len(m), 64)
    assert len(hubs.ids) == 2 and len(hubs.places(m)[2][0])
    got = {r["id"]: r["group_id"] for r in grouping.similarity_components(df, "id", "vec", 16, 0.8, block_rows=64, cell_rows=40).collect()}
    assert got == dict(enumerate(want)) and want[400] == want[0] == want[200]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_nearest_of_some(spark, broadcast):
    m = _vectors()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None)], "item long, v array<double>")
    got = grouping.nearest_of(df, df.where("item % 10 = 1"), "item", "v", 8, 4, most_broadcast=broadcast, block_rows=64).collect()
    sim = np.round(u @ u.T, 6)
    want = {(i, r + 1): j for i in range(1, 400, 10) for r, j in enumerate(sorted((j for j in range(400) if j != i), key=lambda j: (-sim[i, j], j))[:4])}
    assert {(r["item"], r["rank"]): r["other"] for r in got} == want
    assert grouping.nearest_of(df.limit(0), df.limit(0), "item", "v", 8, 4, most_broadcast=broadcast).count() == 0
