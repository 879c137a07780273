"""Row-local operators: types, features, validation, routing, prompts, settings."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanery.functions import html, media, prompts
from gleanery.operators import grouping, judge, recover, route, stats, validate
from gleanery.plans.config import Bursts, Config, Documents, Quality, Routing, find
from gleanery.sources import inventory, profiles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path,kind,ext", [
    ("/a/b.JPG", "image", "jpg"), ("/a/b.MoV", "video", "mov"), ("x.mp3", "audio", "mp3"), ("/a/b.py", "document", "py"), ("/a/b.pdf", "document", "pdf"),
    ("/a/b.bin", None, "bin"), ("/a.b/c", None, ""), ("/a/.jpg", None, ""), ("/a/b.tar.gif", "image", "gif"),
])
def test_types(spark, path, kind, ext):
    p = F.lit(path)
    r = spark.range(1).select(inventory.media_type(p).alias("k"), inventory.extension(p).alias("e")).first()
    assert (r["k"], r["e"]) == (kind, ext)


def test_folder_types(spark):
    rows = [("m", "image"), ("m", "audio"), ("v", "video"), ("i", "image"), ("i", "video"), ("d", "document"), ("a", "audio"), ("e", None)]
    df = spark.createDataFrame(rows, "folder string, media_type string")
    assert {r["folder"]: r["kind"] for r in inventory.predominant_types(df).collect()} == {"m": "mixed", "v": "video", "i": "image", "d": "document", "a": "audio", "e": "image"}


def test_listing(spark, tmp_path):
    for name in ("a.jpg", "b.PNG", "c.txt", "d.bin", "sub/e.mp4", "sub/f.md"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    files = inventory.list_files(spark, str(tmp_path))
    assert sorted(r["file_name"] for r in files.collect()) == ["a.jpg", "b.PNG", "c.txt"]
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    deep = inventory.list_files(spark, str(tmp_path), ("video", "document"), recursive=True)
    assert sorted(r["file_name"] for r in deep.collect()) == ["c.txt", "e.mp4", "f.md"]
    with pytest.raises(FileNotFoundError):
        inventory.list_files(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        inventory.list_files(spark, str(tmp_path / "a.jpg"))
    items = inventory.list_files(spark, str(tmp_path), recursive=True).withColumn("folder", inventory.folder(F.col("path")))
    got = inventory.bundles(items, f"file:{tmp_path}").collect()
    assert [(r["bundle"], r["files"], r["types"]) for r in got] == [("sub", 2, ["document", "video"])]


def test_capture_time(spark):
    stamp = datetime(2024, 2, 3, 4, 5, 6)
    null, t = F.lit(None).cast("timestamp"), F.lit(stamp)
    time = lambda o, m, n, s: one(spark, grouping.capture_time(o, m, F.lit(n), s))
    assert time(t, null, "x", null) == time(null, t, "x", null) == time(null, null, "x.jpg", t) == stamp
    assert time(null, null, "img-20240131-WA1.jpg", t) == datetime(2024, 1, 31, 12)
    assert time(null, null, "IMG-20241331-WA1.jpg", null) is None


@pytest.mark.parametrize("text,path,want", [
    ('{"score": 4}', "$.score", 4), ('```json\n{"score": 4}\n```', "$.score", 4), ('[{"score": 1}]', "$[0].score", 1),
    ('Sure: {"score":4,"dimensions":{"x":3}}', "$.x", 3), ("So {\"score\": 5} ok", "$.score", 5), ("none", "$.score", None), (None, "$.score", None),
])
def test_lenient_json(spark, text, path, want):
    assert one(spark, F.try_variant_get(validate.lenient_json(F.lit(text)), path, "int")) == want


def test_lenient_json_widest_first(spark):
    j = validate.lenient_json(F.lit('Sure: {"score":4,"dimensions":{"x":3}}'), flat_first=False)
    assert one(spark, F.try_variant_get(j, "$.score", "int")) == 4


def test_judgement_repair(spark):
    rows = [("Share", None, None, 0), ("share", "-1", 2, 1), (None, "7", None, 2), ("Ignore", "3.9", None, 3), ("Share", "4", None, 4), ("Share", "x", None, 5)]
    df = spark.createDataFrame(rows, "c string, s string, r int, p int")
    got = {r["p"]: r for r in validate.judgement(df, "c", "s", ["Share", "Storage", "Ignore"], "Review", rank="r", position="p").collect()}
    assert [got[i]["s"] for i in range(6)] == [2, 1, 5, 3, 4, 2]
    assert [got[i]["c"] for i in range(6)] == ["Share", "Review", "Review", "Ignore", "Share", "Review"]
    assert [got[i]["r"] for i in range(3)] == [1, 2, 3] and got[5]["error_type"] == "invalid_response" and not got[4]["is_error_fallback"]


def test_dimensions(spark):
    text = '{"a": 9, "b": "x", "d": 2, "n": "4", "f": 3.9, "t": true, "z": -1, "o": {"x": 1}, "e": null}'
    values = F.parse_json(F.lit(text))
    assert one(spark, validate.dimensions(values, ["a", "b", "c"])) == {"a": 5, "b": None, "c": None}
    rest = one(spark, validate.dimensions(values, ["n", "f", "t", "z", "o", "e"]))
    assert rest == {"n": None, "f": 3, "t": 1, "z": 1, "o": None, "e": None}
    assert one(spark, validate.dimensions(F.parse_json(F.lit("[1]")), ["a"])) == {"a": None}
    assert one(spark, validate.dimensions(F.try_parse_json(F.lit("no")), ["a"])) == {"a": None}
    assert one(spark, F.to_json(validate.dimensions(F.parse_json(F.lit('{"q": 1}')), []))) == '{"q":1}'
    name = lambda t: one(spark, validate.dimension_name(F.lit(t)))
    assert name("Baby's face (clearly visible!)") == "baby_face_clearly_visible"
    assert name("one two three four five six seven eight nine ten") == "one_two_three_four_five_six_seven_eight" and name("!!") is None
    assert one(spark, validate.clean_name(F.lit(' a/b: "c" '))) == "ab c"
    assert one(spark, validate.response_error(F.lit(None).cast("boolean"), F.lit(3), F.lit("x"))) == "safety_blocked"
    assert one(spark, validate.response_shape(F.array(F.lit(1)), F.lit(2))) is False


def test_single_routes(spark):
    cases = [("Ignore", 5, True, True, "Ignore"), ("Share", 5, False, True, "Ignore"), ("Share", 5, None, False, "Review"), ("Review", 5, True, True, "Review"),
             ("Share", 4, None, None, "Share"), ("Share", 3, True, True, "Review"), ("Storage", 5, True, True, "Review"), ("Storage", 2, True, True, "Storage"),
             (None, None, None, None, "Review"), ("Share", None, True, True, "Storage")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c string, s int, k boolean, a boolean, want string")
    got = df.select("want", route.single(F.col("c"), F.col("s"), F.col("k"), F.col("a")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
    by = lambda c, s: one(spark, route.by_threshold(F.lit(c), F.lit(s), {"Strong": 4}, ["Strong", "Other"], "Weak"))
    assert [by("Strong", 4), by("Strong", 3), by("Odd", 5), by("Other", 1), by(None, 5)] == ["Strong", "Weak", "Weak", "Other", "Weak"]
    assert route.score_ranges({"Share": 4, "Review": 2}) == [("Share", 4, 5), ("Review", 2, 3)]


BURST = "b string, i int, c string, s int, r int, k boolean, a boolean, v array<double>"


def test_burst_routes(spark):
    rows = [("x", 0, "Share", 5, 1, True, True, [1.0, 0.0]), ("x", 1, "Share", 4, 2, True, True, [0.9999, 0.01]), ("x", 2, "Share", 4, 3, True, True, [0.0, 1.0]),
            ("x", 3, "Storage", 2, None, None, None, None), ("y", 0, "Storage", 5, 1, True, True, None), ("y", 1, "Share", 5, 2, True, False, None)]
    df = spark.createDataFrame(rows, BURST)
    args = ("b", "i", "c", "s", "r", "k", "a")
    got = {(r["b"], r["i"]): r["destination"] for r in route.burst(df, *args, vec="v", too_similar=0.9).collect()}
    assert got == {("x", 0): "Share", ("x", 1): "Review", ("x", 2): "Review", ("x", 3): "Storage", ("y", 0): "Share", ("y", 1): "Review"}
    plain = {(r["b"], r["i"]): r["destination"] for r in route.burst(df, *args).collect()}
    assert plain[("x", 1)] == "Share" and len(plain) == 6
    assert route.burst(df.limit(0), *args, vec="v").count() == 0


def test_media_arithmetic(spark):
    assert one(spark, media.quality(F.lit(400.0), F.lit(255.0))) == pytest.approx(1.0)
    assert one(spark, media.quality(F.lit(None).cast("double"), F.lit(1.0))) == 0.0
    def face(*found, most=10):
        rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("w", "h", "eyes", "smiles"), f)]) for f in found]
        boxes = F.array(*rows) if rows else F.expr("cast(null as array<struct<w:int,h:int,eyes:int,smiles:int>>)")
        return tuple(one(spark, media.faces(boxes, F.lit(100), F.lit(100), most)))

    assert face((10, 10, 2, 0), (20, 20, 1, 0)) == (2, 0.05, 0.04, 1, 0.025, 1, 0)
    assert face((10, 10, 2, 3), (20, 20, 3, 1), (10, 10, 0, 0), most=2) == (2, 0.06, 0.04, 1, pytest.approx(0.02), 2, 2)
    assert face() == (0, 0.0, 0.0, 0, 0.0, 0, 0)
    assert one(spark, media.frame_indices(F.lit(10), 4)) == [0, 2, 5, 7] and one(spark, media.frame_indices(F.lit(3), 4)) == [0, 1, 2]
    assert one(spark, media.frame_indices(F.lit(0), 4)) == []
    assert one(spark, media.closest_ratio(F.lit(1920), F.lit(1080))) == "16:9" and one(spark, media.closest_ratio(F.lit(0), F.lit(5))) is None
    assert [n for n, _ in media.RATIOS] == ["1:1", "2:3", "3:2", "3:4", "4:3", "9:16", "16:9", "21:9"]
    sizes = spark.createDataFrame([(w, h) for w in range(1, 60, 3) for h in range(1, 60, 4)], "w int, h int")
    for r in sizes.withColumn("got", media.closest_ratio(F.col("w"), F.col("h"))).collect():
        assert r["got"] == min(media.RATIOS, key=lambda x: abs(x[1] - r["w"] / r["h"]))[0]
    assert tuple(one(spark, media.fitted_size(F.lit(2000), F.lit(1001), 1000))) == (1000, 500)
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, media.cosine(a, b)) == 0.0 and one(spark, media.cosine(b, b)) == 1.0
    assert one(spark, media.cosine(a, F.lit(None).cast("array<double>"))) == 0.0 and one(spark, media.normalised(b)) == [0.0, 1.0]


def test_texts(spark):
    assert one(spark, media.word_count(F.lit("  a b\n c "))) == 3 and one(spark, media.word_count(F.lit(None).cast("string"))) == 0
    assert one(spark, media.marked_cut(F.lit("abcdef"), 3, "!")) == "abc!" and one(spark, stats.shortened(F.lit("x" * 61))) == "x" * 57 + "..."
    assert one(spark, media.decoded(F.lit(b"caf\xc3\xa9"))) == "café" and one(spark, media.decoded(F.lit(b"caf\xe9"))) == "café"
    assert html.html_text('<p>a<script>var t = "</p>";</script> b</p><style>x</style>c') == "a\nb\nc" and html.html_text(None) is None
    key = one(spark, media.file_key(F.lit("a"), F.lit(10), F.lit("1.5")))
    assert key == hashlib.sha256(b"a_10_1.5").hexdigest()
    assert one(spark, media.group_key(F.array(F.lit("b"), F.lit("a")))) == hashlib.sha256(b"a_b").hexdigest()
    at = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp")
    assert [one(spark, media.expired(at(1), at(d), 7)) for d in (8, 9)] == [False, True]
    assert one(spark, media.expired(at(1), at(9), 0)) is False and one(spark, media.expired(F.lit(None), at(9), 7)) is True


PROFILE = {
    "name": "n", "description": "d", "categories": [{"name": "Share", "description": "x"}, {"name": "Storage"}, {"name": "Review"}], "default_category": "Review",
    "top_priorities": [f"p{i}" for i in range(9)], "thresholds": {"Share": 4, "Review": 3}, "dimensions": [{"name": "sharp"}],
    "positive_criteria": {"must_have": ["m"]}, "negative_criteria": {"n": ["a", "b", "c", "d"]}, "scoring_rubric": {"1": "bad", "5": "good"},
}


def test_prompts(spark):
    text = prompts.head(PROFILE, "image")
    assert "4 or more: Share" in text and "3: Review" in text and "2 or less: Storage" in text
    assert "p6" in text and "p7" not in text and "- d\n" not in text and text.index("5: good") < text.index("1: bad") and "- sharp" in text
    assert "list of 3 objects" in prompts.head(PROFILE, "image", 3) and prompts.score_rule({}) == ""
    got = one(spark, prompts.item_prompt(PROFILE, "document", F.lit("f.txt"), F.lit("x" * 40_000)))
    assert got.endswith("[cut]") and "Item: f.txt" in got and len(got) < 32_000
    names = F.array(*[F.lit(f"c{i}") for i in range(7)])
    assert one(spark, prompts.sibling_line(names)) == "c0, c1, c2, c3, c4 (+2 more)"
    dims = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(None).cast("int"))
    assert one(spark, prompts.correction_line(F.lit("f"), F.lit("x"), F.lit("y"), dims)) == "f: x -> y (a=1)"


def test_config(tmp_path):
    assert Config.of({"routing": {"share_threshold": 5, "odd": 1}, "odd": 2}).routing.share_threshold == 5 and Config.of(None) == Config()
    for bad in (lambda: Routing(share_threshold=3), lambda: Routing(share_threshold=6), lambda: Routing(retries=-1), lambda: Bursts(least=1),
                lambda: Bursts(least=5, most=4), lambda: Bursts(similarity=1.5), lambda: Quality(0.8, 0.3), lambda: Documents(similarity=-1)):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "gleanery.json").write_text("{}")
    assert find(None, tmp_path / "none", tmp_path) == tmp_path / "gleanery.json" and find(None) is None


class Moody:
    name = "moody"

    def __init__(self, *script):
        self.script = list(script)

    def reply(self, prompt):
        step = self.script.pop(0)
        if isinstance(step, Exception):
            raise step
        return step


def test_retries():
    slept = []
    retry = judge.Retry(attempts=3, delay=2.0, sleep=slept.append)
    assert judge.ask(Moody(OSError("x"), "", "ok"), "p", retry) == ("ok", None, None, 2) and slept == [2.0, 4.0]
    assert judge.ask(Moody(*[OSError("x")] * 3), "p", retry)[1:] == ("api_error", "x", 2)
    only = judge.Retry(attempts=3, kinds=("invalid_response",), sleep=slept.append)
    assert judge.ask(Moody(OSError("x"), "ok"), "p", only)[1:] == ("api_error", "x", 0)


def test_judging(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, prompt string")
    got = {r["k"]: r for r in judge.judged(df, "k", "prompt", judge.SteadyJudge()).collect()}
    assert got[1]["reply"] == judge.SteadyJudge().reply("a") and got[3]["error_type"] == "load_error"
    many = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "k int, prompt string")
    want = {i: judge.SteadyJudge().reply(f"p{i}") for i in range(50)}
    for workers in (1, 10):
        assert {r["k"]: r["reply"] for r in judge.judged(many, "k", "prompt", judge.SteadyJudge(), workers=workers).collect()} == want
    cache = spark.createDataFrame([(1, "kept")], "k int, reply string")
    again = {r["k"]: (r["reply"], r["cached"]) for r in judge.with_cache(df, cache, "k", "prompt", judge.SteadyJudge()).collect()}
    assert again[1] == ("kept", True) and again[2] == (got[2]["reply"], False) and len(again) == 3
    lines = spark.createDataFrame([("g", i, f"l{i}") for i in range(12)], "g string, p int, l string")
    chunks = {r["chunk"]: (r["members"], r["prompt"].split("\n")[0]) for r in judge.group_prompts(lines, "g", "p", "l").collect()}
    assert chunks == {0: (10, "l0"), 1: (2, "l10")}


def test_recovery(spark):
    rows = [(1, None, True), (2, "a", True), (3, "a", True), (4, "b", True), (5, "b", None), (6, "c", False), (7, None, False), (8, "", True), (9, "", False)]
    df = spark.createDataFrame(rows, "i int, b string, e boolean")
    plan = {r["unit"]: (r["mode"], r["items"]) for r in recover.reprocess_plan(df, "b", "i", "e").collect()}
    assert plan == {"item-1": ("single", 1), "a": ("whole", 2), "b": ("members", 1), "item-8": ("single", 1)}
    clear = {r["i"]: r["reason"] for r in recover.clear_plan(df, "b", "i", "e").collect()}
    assert clear == {1: "error", 2: "error", 3: "error", 4: "error", 5: "burst", 8: "error"}
    assert recover.failed(df).count() == 0
    assert one(spark, recover.is_error(None, F.lit("Fallback response: x"))) is True and one(spark, recover.is_error(None, F.lit(None).cast("string"))) is False
    items = spark.createDataFrame([("p",), ("q",), ("r",)], "path string")
    place = recover.current_place(items, spark.createDataFrame([("p", "rev/p")], "path string, copy string"), spark.createDataFrame([("p",), ("q",)], "path string"), "path")
    assert {r["path"]: r["place"] for r in place.collect()} == {"p": "rev/p", "q": "q"}


def test_profiles(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "a", "version": 1, "thresholds": {"Share": 4}}')
    (tmp_path / "b.json").write_text("{broken")
    assert [r["name"] for r in profiles.profiles(spark, str(tmp_path)).collect()] == ["a"]
    assert profiles.feedback(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "s.json").write_text('{"session_id": "s", "total_photos": 4, "bursts": [["x"]]}')
    assert profiles.sessions(spark, str(tmp_path / "s")).first()["total_files"] == 4
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "name string, version int, d string")
    assert {r["name"]: r["d"] for r in profiles.current(versions).collect()} == {"a": "y", "b": "z"}
    assert profiles.revised({"name": "a", "version": 1, "philosophy": "p"}, {"philosophy": "q", "odd": 1, "name": "z", "thresholds": None}) == {"name": "a", "version": 2, "philosophy": "q"}


def test_report_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s", "Share", 5, 'a "b", c\nd', ["x", "y"])], "source string, destination string, score int, reasoning string, key_topics array<string>")
    out = str(tmp_path / "classification_report_1.csv")
    profiles.write_report(rows, out)
    got = profiles.report(spark, out).first()
    assert (got["source"], got["score"], got["reasoning"], got["key_topics"], got["burst_id"]) == ("s", 5, 'a "b", c\nd', "x,y", None) and len(got) == 17
    profiles.write_routed(rows, str(tmp_path / "routed"))
    assert spark.read.parquet(str(tmp_path / "routed")).where("destination = 'Share'").count() == 1
