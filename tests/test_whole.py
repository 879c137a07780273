"""Queries and operators that take the whole input, not a part of it."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from gleanery.functions import html
from gleanery.operators import grouping
from gleanery.plans import queries
from gleanery.plans.config import Bursts, Config
from gleanery.plans.pipeline import Pipeline

SF = "/root/testdata/sf0.001"


def test_html_of_every_text(spark):
    assert html.html_text("<p>Caf&eacute;&nbsp;&#8211; \u201ena\u00efve\u201c</p><script>\u00fc</script>\u2003Z\u00fcrich\u00a0") == "Caf\u00e9\u00a0\u2013 \u201ena\u00efve\u201c\nZ\u00fcrich"
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").where("text is not null").collect()}
    got = {r["doc_id"]: r["text"] for r in queries.html_text(spark, SF).collect()}
    assert got == {k: " ".join(t.split()) for k, t in texts.items()}
    assert any(not t.isascii() for t in got.values())


def test_feedback_of_every_config(spark):
    rows = queries.judgements(spark, SF, "config_id", "item_id")
    assert rows.where("config_id <> 1").count() > 0
    assert sum(r["n"] for r in queries.feedback_reasons(spark, SF).collect()) == rows.count()
    last = [r["judged_at"] for r in queries.judgements(spark, SF, "judged_at").where("judged_at is not null").collect()]
    assert [r["submitted_at"] for r in queries.feedback_recent(spark, SF).collect()] == sorted(last)[-20:]
    known = {r["item_id"] for r in rows.collect()}
    assert {r["item_id"] for r in queries.correction_table(spark, SF).collect()} == known and any((i or 0) % 5 for i in known)


@pytest.mark.parametrize("most, least, keep", [(50, 2, True), (4, 3, True), (4, 3, False)])
def test_bursts_of_large_groups_are_those_of_whole_groups(spark, most, least, keep):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    vecs = [(centres[k % 12] + rng.normal(scale=0.28, size=8)).tolist() for k in range(300)]
    vecs[7], vecs[20], vecs[33], vecs[50] = None, [], [1.0, 2.0], [0.0] * 8
    rows = [(1000 + k, "big" if k < 240 else "small", k if k < 240 else k - 240, 240 if k < 240 else 60, vecs[k]) for k in range(300)]
    df = spark.createDataFrame(rows, "item long, group_id string, group_index int, group_size int, v array<double>")
    run = lambda **x: sorted(map(tuple, grouping.similar_bursts(df, "item", "v", "", 0.9, least, most, keep, **x).collect()))
    whole = run()
    assert run(max_group=100, block_rows=37) == whole == run(max_group=30, block_rows=500)
    assert max(r[3] for r in whole) == min(most, max(r[3] for r in whole)) > 2


def test_visual_groups_cross_stretches(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 8))
    rows = [(k, (centres[k % 5] + rng.normal(scale=0.2, size=8)).tolist()) for k in range(90)]
    df = spark.createDataFrame(rows, "item long, v array<double>")
    whole = sorted(map(tuple, grouping.visual_groups(df, "item", "v").collect()))
    assert sorted(map(tuple, grouping.visual_groups(df, "item", "v", max_group=20).collect())) == whole
    assert max(r[3] for r in whole) > 10


def test_pipeline_groups_by_similarity(spark):
    at = datetime(2024, 1, 1)
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(k, f"/a/{k}.jpg", "image", "/a", at + timedelta(seconds=k), x if k < 5 else y) for k in range(7)]
    rows += [(8, "/a/8.jpg", "image", "/a", at + timedelta(seconds=7), None), (9, "/a/9.jpg", "image", "/a", None, x)]
    df = spark.createDataFrame(rows, "item_id long, path string, media_type string, folder string, at timestamp, embedding array<double>")
    out = Pipeline(config=Config(bursts=Bursts(least=2, most=3))).run(df).collect()
    got = {r["item_id"]: (r["group_id"], r["group_index"], r["group_size"]) for r in out}
    assert len(out) == 9 and got == {
        0: (0, 0, 3), 1: (0, 1, 3), 2: (0, 2, 3), 3: (3, 0, 2), 4: (3, 1, 2), 5: (5, 0, 2), 6: (5, 1, 2), 8: (8, 0, 1), 9: (9, 0, 1),
    }
