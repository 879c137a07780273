"""Problems 1, 2 and 6 against brute force, and their edge cases."""

import math
import time

import numpy as np
import pytest

from gleanery.llm import clusters, neighbours, quotas, subset
from gleanery.llm import kdtree
from gleanery.llm.kdtree import KdTree

SHAPE = "feature_id long, embedding array<float>, vec string, rep int, id string, f1 string, miss int"


def _dense(seed=3, groups=40, size=12, alone=400, dim=64):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((groups, dim))
    near = np.repeat(heads / np.linalg.norm(heads, axis=1, keepdims=True), size, axis=0) + 0.05 * rng.standard_normal((groups * size, dim))
    return np.concatenate([near, rng.standard_normal((alone, dim))]).astype(np.float32)


def _rows(m, start=1):
    return [(start + i, [float(x) for x in v], "clash", 5, "clash", "clash", 1) for i, v in enumerate(m)]


def _dirty():
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 64, [nan] + [1.0] * 63, [inf] + [1.0] * 63, [1.0] * 63, [None] + [1.0] * 63]
    return [(9000 + i, v, None, None, None, None, None) for i, v in enumerate(bad)] + [(None, [1.0] * 64, "", 1, "", "", 1)]


def _brute(ids, m, k, limit):
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    near = {}
    for i in range(len(ids)):
        other = sorted((-sim[i, j], ids[j]) for j in range(len(ids)) if j != i and sim[i, j] >= limit)
        near[ids[i]] = [b for _, b in other[:k]]
    comp = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(sim >= limit)):
            low = min(comp[i], comp[j])
            if comp[i] != low or comp[j] != low:
                comp[i] = comp[j] = low
                changed = True
    return near, {ids[i]: ids[comp[i]] for i in range(len(ids))}


@pytest.fixture(scope="module")
def table(spark):
    m = _dense()
    m = np.concatenate([m, m[:3], m[:1], m[:1], m[:1], m[:1], m[:1], m[:1], m[:1]])  # copies, one of them eight times
    rows = _rows(m)
    df = spark.createDataFrame(rows + rows[:5] + _dirty(), SHAPE)
    near, comp = _brute([r[0] for r in rows], m, 5, 0.85)
    return df, near, comp


def test_nearest_is_exact_in_one_leaf(table):
    df, near, _ = table
    got = {}
    for r in neighbours.nearest(df, "feature_id", "embedding", 64).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["other"]
    assert {i: [o for _, o in sorted(v.items())] for i, v in got.items()} == {i: v for i, v in near.items() if v}


def test_nearest_with_many_leaves_recalls_most(table):
    df, near, _ = table
    got = {(r["id"], r["other"]) for r in neighbours.nearest(df, "feature_id", "embedding", 64, leaf_rows=64).collect()}
    want = {(i, o) for i, v in near.items() for o in v}
    assert len(got & want) >= 0.9 * len(want)


def test_recall_of_the_index_for_every_hundredth_row(spark):
    """The stated query set: ids divisible by 100 against all rows, recall against brute force at least 0.9."""
    m = _dense(seed=8, groups=200, size=20, alone=2000)
    df = spark.createDataFrame(_rows(m, 0), SHAPE)
    got = {}
    for r in neighbours.nearest(df, "feature_id", "embedding", 64, leaf_rows=512).where("id % 100 = 0").collect():
        got.setdefault(r["id"], set()).add(r["other"])
    u = m.astype(np.float64) / np.linalg.norm(m, axis=1, keepdims=True)
    hit = total = 0
    for i in range(0, len(m), 100):
        s = np.round(u @ u[i], 9)
        s[i] = -2
        want = {j for j in sorted(range(len(m)), key=lambda j: (-s[j], j))[:5] if s[j] >= 0.85}
        hit, total = hit + len(want & got.get(i, set())), total + len(want)
    assert total > 100 and hit >= 0.9 * total


def test_clusters_are_the_components(table):
    df, _, comp = table
    members, points = clusters.clusters(df, "feature_id", "embedding", 64, 0.85, least=3)
    got = {r["id"]: (r["cluster"], r["size"]) for r in members.collect()}
    size = {}
    for c in comp.values():
        size[c] = size.get(c, 0) + 1
    assert got == {i: (c, size[c]) for i, c in comp.items() if size[c] >= 3}
    typical = clusters.typical_members(members, points, 64).collect()
    assert {r["rank"] for r in typical} == {1, 2, 3}
    assert all(got[r["id"]][0] == r["cluster"] for r in typical)


def test_clusters_over_cells_and_blocks(table):
    """Small cells and blocks: links cross cell borders and hot cells are divided."""
    df, _, comp = table
    members, _ = clusters.clusters(df, "feature_id", "embedding", 64, 0.85, least=2, cell_rows=64, block_rows=16)
    got = {r["id"]: r["cluster"] for r in members.collect()}
    size = {}
    for c in comp.values():
        size[c] = size.get(c, 0) + 1
    want = {i: c for i, c in comp.items() if size[c] >= 2}
    assert sum(got.get(i) == c for i, c in want.items()) >= 0.98 * len(want)


def test_exact_clusters_over_many_cells(spark):
    """A group that is spread around the limit lies in many cells; exact finds every link, over cells and blocks."""
    rng = np.random.default_rng(7)
    m = [rng.standard_normal(64)]
    for _ in range(600):  # a walk whose steps are just near enough
        x = m[-1] / np.linalg.norm(m[-1])
        step = rng.standard_normal(64)
        step -= (step @ x) * x
        c = 0.852 + 0.05 * rng.random() ** 3
        m.append(c * x + math.sqrt(1 - c * c) * step / np.linalg.norm(step))
    m = np.array(m, np.float32)
    df = spark.createDataFrame(_rows(m), SHAPE)
    _, comp = _brute(list(range(1, len(m) + 1)), m, 1, 0.85)
    for tuning in (dict(cell_rows=20), dict(cell_rows=100, block_rows=40)):
        members, _ = clusters.clusters(df, "feature_id", "embedding", 64, 0.85, least=1, exact=True, **tuning)
        assert {r["id"]: r["cluster"] for r in members.collect()} == comp


def test_core_rows_need_not_ask():
    rng = np.random.default_rng(8)
    head = rng.standard_normal(64)
    m = np.concatenate([head / np.linalg.norm(head) + s * rng.standard_normal((n, 64)) for s, n in ((0.01, 60), (0.06, 60))] + [rng.standard_normal((30, 64))])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    core = u @ (head / np.linalg.norm(head)) >= math.sqrt((1 + 0.85) / 2) + 1e-7
    assert core.sum() >= 60
    assert (clusters.local_components(u, 0.85, core=core) == clusters.local_components(u, 0.85)).all()


def test_empty_tables(spark):
    df = spark.createDataFrame([], SHAPE)
    assert neighbours.nearest(df, "feature_id", "embedding", 64).count() == 0
    members, points = clusters.clusters(df, "feature_id", "embedding", 64)
    assert members.count() == 0 and clusters.typical_members(members, points, 64).count() == 0
    only_bad = spark.createDataFrame(_dirty(), SHAPE)
    assert neighbours.nearest(only_bad, "feature_id", "embedding", 64).count() == 0
    assert clusters.clusters(only_bad, "feature_id", "embedding", 64)[0].count() == 0


def test_local_components_match_brute_force():
    m = _dense(seed=5, groups=6, size=150, alone=50)
    u = m.astype(np.float64) / np.linalg.norm(m, axis=1, keepdims=True)
    label = clusters.local_components(u, 0.85)
    _, comp = _brute(list(range(len(m))), m, 1, 0.85)
    size = np.bincount(list(comp.values()), minlength=len(m))
    assert [int(x) for x in label] == [comp[i] if size[comp[i]] > 1 else -1 for i in range(len(m))]


def test_chance_of_a_box_is_the_share_that_falls_into_it():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.4 / 8 * rng.standard_normal(x.shape)
    seen, said = [], []
    for seed in range(12):  # the chance is one over random projections
        basis = np.random.default_rng(seed).standard_normal((64, 8))
        p, q = x @ basis, y @ basis
        tree = KdTree(p, 4)
        at = tree.leaves(p)
        assert set(at) == set(range(16))
        seen.append((at == tree.leaves(q)).mean())
        d = np.linalg.norm(x - y, axis=1)
        said.append(np.mean([kdtree.inside(p[at == k], *tree.box(k), d[at == k]).mean() for k in range(16)]))
    assert abs(np.mean(seen) - np.mean(said)) < 0.02


def test_chi_square():
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((200_000, 24)) ** 2).sum(axis=1)
    for chance in (0.1, 0.5, 0.99):
        reach = kdtree.chi_square_reach(chance, 24)
        assert abs((x <= reach).mean() - chance) < 0.005 and abs(kdtree.chi_square(reach, 24) - chance) < 1e-9


def test_leaves_of_deep_trees_are_even():
    """A sample that grows with the leaves: the largest of 16,384 leaves holds at most four times the mean."""
    rng = np.random.default_rng(3)
    heads = rng.standard_normal((300, 64))
    m = np.concatenate([heads[rng.integers(0, 300, 250_000)] + 0.3 * rng.standard_normal((250_000, 64)), rng.standard_normal((150_000, 64))])
    p = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32) @ rng.standard_normal((64, 24)).astype(np.float32)
    p = p[rng.permutation(len(p))]
    size = np.bincount(KdTree(p[:262_144], 14).leaves(p), minlength=2**14)
    assert size.max() <= 4 * size.mean() and (size == 0).mean() < 0.01


def test_overfull_leaves_are_divided():
    rng = np.random.default_rng(4)
    fit = rng.standard_normal((500, 64)).astype(np.float32)
    tree = neighbours._Tree(fit, 24, 0, 1, 100, 0.99)
    p = tree.project(rng.standard_normal((5000, 64)))
    parts = list(tree.parts(0, p))
    assert sorted(np.concatenate([r for r, _ in parts])) == list(range(5000)) and max(len(r) for r, _ in parts) <= 400
    for rows, (low, high) in parts:
        assert (p[rows] >= low).all() and (p[rows] < high).all()


def test_rows_that_still_ask_are_compared_with_all(spark):
    m = _dense(seed=4, groups=30, size=10, alone=200)
    df = spark.createDataFrame(_rows(m), SHAPE)
    near, _ = _brute(list(range(1, len(m) + 1)), m, 5, 0.85)
    tuning = dict(leaf_rows=16, sure=0.999999, planned=0.999999, max_trees=1)
    part = {(r["id"], r["other"]) for r in neighbours.nearest(df, "feature_id", "embedding", 64, **tuning).collect()}
    whole = {(r["id"], r["other"]) for r in neighbours.nearest(df, "feature_id", "embedding", 64, exact=True, block_rows=100, **tuning).collect()}
    want = {(i, o) for i, v in near.items() for o in v}
    assert whole == want and part != want


def test_places_of_few_hits_are_found_fast():
    """Searching the whole matrix by np.nonzero was over a third of p2's time."""
    rng = np.random.default_rng(5)
    hit = rng.random((400, 10_000)) < 1e-4
    for m in (hit, hit[:, :0], hit[:0], ~hit[:9, :11], hit[::2, ::3]):
        for got, want in zip(neighbours._places(m), np.nonzero(m)):
            assert got.tolist() == want.tolist()

    def least(find):
        return min(_cpu(lambda: find(hit)) for _ in range(7))

    assert least(neighbours._places) < 0.7 * least(np.nonzero)


def _cpu(run):
    began = time.process_time()
    run()
    return time.process_time() - began


def test_quotas_are_balanced_and_exact():
    got = quotas.balanced_quotas({(0, "a"): (100, 0), (0, "b"): (2, 0), (1, "a"): (100, 50), (1, "b"): (100, 0)}, 60)
    assert sum(got.values()) == 60
    assert got[(0, "a")] + got[(0, "b")] == got[(1, "a")] + got[(1, "b")] == 30
    assert got[(0, "b")] == 2 and got[(1, "b")] == 28
    assert sum(quotas.balanced_quotas({(0, "a"): (3, 4)}, 60).values()) == 7
    assert quotas.balanced_quotas({(0, "a"): (3, 4)}, 2) == {(0, "a"): 2}
    assert quotas.balanced_quotas({}, 5) == {}


@pytest.fixture(scope="module")
def parts(spark):
    m = _dense(seed=9, groups=10, size=30, alone=200)
    rows = [(int(i), [float(x) for x in v], 1 + i % 2, "pdf" if i % 3 else None) for i, v in enumerate(m)]
    rows += [(7000, None, 1, "txt"), (7001, [0.0] * 64, 2, "txt"), (None, [1.0] * 64, 1, "pdf"), (8000, [1.0] * 64, None, "pdf")]
    return m, spark.createDataFrame(rows + rows[:3], "rep long, vec array<float>, part long, value string")


def test_subset_has_its_size_and_no_similar_pair(parts):
    m, df = parts
    got = subset.varied_subset(df, "rep", "vec", "part", "value", 64, {1: (60, 0.85), 2: (40, 0.9)}).collect()
    assert sum(r["part"] == 1 for r in got) == 60 and sum(r["part"] == 2 for r in got) == 40
    assert len({(r["part"], r["id"]) for r in got}) == 100 and not any(r["repeated"] for r in got)
    u = m.astype(np.float64) / np.linalg.norm(m, axis=1, keepdims=True)
    for part, cut in ((1, 0.85), (2, 0.9)):
        ids = [r["id"] for r in got if r["part"] == part]
        s = u[ids] @ u[ids].T
        np.fill_diagonal(s, 0)
        assert s.max() < cut
    assert len({r["region"] for r in got}) >= 10


def test_subset_takes_repeats_only_when_nothing_else_is_left(parts):
    _, df = parts
    got = subset.varied_subset(df, "rep", "vec", "part", "value", 64, {1: (10_000, 0.85)}).collect()
    assert len(got) == 251 and sum(r["region"] == -1 for r in got) == 1
    assert subset.varied_subset(df.limit(0), "rep", "vec", "part", "value", 64, {1: (5, 0.9)}).count() == 0
    assert subset.varied_subset(df, "rep", "vec", "part", "value", 64, {}).count() == 0


def test_hashed_features(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, "one three"), (3, None), (4, "")], "doc long, text string")
    got = {r["id"]: r["vec"] for r in clusters.hashed_features(df, "doc", "text", 16).collect()}
    assert got[3] is None and got[4] is None and len(got[1]) == 16 and any(got[1]) and got[1] != got[2]


def test_a_third_of_all_rows_in_one_tight_group(spark):
    """Hot cells are worked off in pairs of blocks, and kd-trees divide what is dense; nothing is lost."""
    rng = np.random.default_rng(12)
    head = rng.standard_normal(64)
    m = np.concatenate([head / np.linalg.norm(head) + 0.03 * rng.standard_normal((300, 64)), rng.standard_normal((600, 64))]).astype(np.float32)
    df = spark.createDataFrame(_rows(m), SHAPE)
    near, comp = _brute(list(range(1, 901)), m, 5, 0.85)
    members, _ = clusters.clusters(df, "feature_id", "embedding", 64, 0.85, least=3, cell_rows=300, block_rows=64)
    assert {r["id"] for r in members.collect()} == {i for i, c in comp.items() if list(comp.values()).count(c) >= 3} == set(range(1, 301))
    got = {(r["id"], r["other"]) for r in neighbours.nearest(df, "feature_id", "embedding", 64, leaf_rows=200).collect()}
    want = {(i, o) for i, v in near.items() for o in v}
    assert len(want) == 1500 and len(got & want) >= 0.9 * len(want)
