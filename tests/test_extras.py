"""Views, fallbacks, groups for training, prompts of bundles."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleanery.operators import grouping, judge, labels, validate
from gleanery.plans import views
from gleanery.sources import inventory

SF = "/root/testdata/sf0.001"


def test_views(spark):
    names = views.register(spark, SF, ["media_items", "documents"])
    assert "gl_routes" in names
    row = spark.sql("select gl_extension('/a/b.JPG') e, gl_folder('/a/b.JPG') f, gl_word_count(' a b ') w, gl_clean_name('a/b\\\\c: ') c, gl_clamped(7.9) k, gl_clamped(null) n").first()
    assert tuple(row) == ("jpg", "/a", 2, "abc", 5, None)
    n = spark.sql("select count(*) n from gl_items i join gl_sessions s using (item_id)").first()["n"]
    assert n == spark.table("media_items").count()
    assert spark.sql("select count(distinct destination) n from gl_routes").first()["n"] == 4


def test_fallbacks(spark):
    df = spark.createDataFrame([(1, None, "down"), (2, "load_error", None)], "i int, e string, m string")
    got = {r["i"]: r for r in validate.fallback(df, "Review", F.col("e"), F.col("m"), expected=["a"]).collect()}
    assert got[1]["error_type"] == "api_error" and got[1]["reasoning"] == "Fallback response: down" and got[1]["dimensions"] == {"a": None}
    assert got[2]["error_type"] == "load_error" and got[2]["score"] == 2 and got[2]["is_error_fallback"]
    doc = validate.with_extras(spark.createDataFrame([(None,), ("s",)], "content_summary string"), "document").collect()
    assert [(r["content_summary"], r["key_topics"]) for r in doc] == [("", []), ("s", [])]
    assert validate.with_extras(df, "video").first()["audio_quality"] == "unknown" and validate.with_extras(df, "image").columns == df.columns


def test_training_groups(spark):
    t = datetime(2024, 1, 1)
    images = spark.createDataFrame([(1, "/a", t), (2, "/a", t + timedelta(seconds=3)), (3, "/a", None)], "item_id long, folder string, at timestamp")
    videos = spark.createDataFrame([(4,)], "item_id long")
    docs = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.9, 0.1]), (7, None)], "item_id long, embedding array<float>")
    got = {r["item_id"]: (r["group_id"], r["kind"]) for r in grouping.training_groups(images, videos, docs, 2).collect()}
    assert got == {1: (1, "image"), 2: (1, "image"), 3: (3, "image"), 4: (4, "video"), 5: (5, "document"), 6: (5, "document"), 7: (7, "document")}


def test_visual_groups(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.99, 0.05]), (4, None)]
    got = {r["item"]: (r["burst_id"], r["burst_size"]) for r in grouping.visual_groups(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v").collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_group_replies(spark):
    groups = spark.createDataFrame([("g", 0), ("g", 1), ("g", 2)], "g string, p int")
    replies = spark.createDataFrame([("g", ["x", "y"])], "g string, r array<string>")
    assert {r["p"]: r["judgement"] for r in judge.spread(groups, replies, "g", "p", "r").collect()} == {0: "x", 1: "y", 2: None}
    files = spark.createDataFrame([("b", f"/b/{i:03d}", f"f{i}") for i in range(60)] + [("c", "/c/1", "only")], "b string, path string, l string")
    got = {r["b"]: r for r in judge.bundle_prompts(files, "b", "path", "l", most=3).collect()}
    assert got["b"]["prompt"] == "f0\nf1\nf2\n(+57 more)" and got["c"]["prompt"] == "only"


def test_small_rules(spark):
    sides = spark.createDataFrame([("share",), ("storage",), ("Share",), ("storage",)], "side string")
    assert labels.share_ratio(sides) == 0.5 and labels.share_ratio(sides.limit(0)) == 0.275
    drawn = [labels.next_kind(set(labels.KINDS), i) for i in range(2000)]
    assert drawn == [labels.next_kind(set(labels.KINDS), i) for i in range(2000)] and 0.45 < drawn.count("within_burst") / 2000 < 0.55
    assert labels.next_kind({"gallery"}, 3) == "gallery" and labels.next_kind(set(), 3) is None
    items = spark.createDataFrame([("/a/b.jpg",), ("/a/c.mp3",)], "path string").select("path", inventory.media_type(F.col("path")).alias("media_type"))
    row = inventory.kinds(items).first()
    assert row.asDict() == {"image": True, "video": False, "audio": True, "document": False, "kind": "mixed"}
    assert inventory.kinds(items.limit(0)).first()["kind"] == "image"
