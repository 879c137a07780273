"""Problem 7 with a share of coverage: moved and edited passages."""

import random

import numpy as np
import pytest

from gleanery.llm import leaks


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_reordered_leaks(spark, broadcast):
    w = [f"w{i}" for i in range(40)]
    pieces = [w[i : i + 6] for i in range(0, 36, 6)]
    moved = " x ".join(" ".join(p) for p in pieces[::-1])
    docs = [(1, moved), (2, " ".join(w[:12])), (3, " x ".join(" ".join(p) for p in pieces[1::3])), (4, "a b c d e f"), (5, None)]
    items = [(10, " ".join(w)), (11, "a b c d e f"), (12, "")]
    rows = leaks.leaks(
        spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t",
        broadcast_seeds=broadcast, share=0.5,
    ).collect()
    got = {(r["doc"], r["item"]): (r["longest"], r["covered"], r["tiles"]) for r in rows}
    assert got == {(1, 10): (6, 36, 6), (2, 10): (12, 12, 1), (4, 11): (6, 6, 1)} and len(rows) == 3


def test_coverage_matches_brute_force(spark):
    rng = random.Random(3)
    items = [(i, [f"v{rng.randrange(60)}" for _ in range(rng.randint(4, 30))]) for i in range(12)]
    docs = []
    for d in range(80):
        words = items[d % 12][1]
        cut = [words[k : k + rng.randint(3, 11)] for k in range(0, len(words), 7)]
        rng.shuffle(cut)
        docs.append((d, " y ".join(" ".join(c) for c in cut)))
    rows = leaks.leaks(
        spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame([(i, " ".join(x)) for i, x in items], "i long, t string"), "i", "t", share=0.5
    ).collect()
    number = {x: k + 1 for k, x in enumerate(sorted({y for _, t in docs for y in t.split()} | {y for _, x in items for y in x}))}
    code = lambda words: np.array([number[x] for x in words], np.uint64)
    want = {}
    for d, t in docs:
        for i, x in items:
            n = [k for *_, k in leaks.tiles(code(t.split()), code(x), 5)]
            if n and (max(n) >= 10 or sum(n) >= 0.5 * len(x)):
                want[d, i] = (max(n), sum(n))
    assert {(r["doc"], r["item"]): (r["longest"], r["covered"]) for r in rows} == want
    assert any(n < 10 for n, _ in want.values())
