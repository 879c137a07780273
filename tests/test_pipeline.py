"""Sinks, office files, embeddings and the whole pipeline."""

import io
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import embed, office
from gleanery.operators import judge, labels, recover
from gleanery.plans import config as settings
from gleanery.plans.config import Config
from gleanery.plans.pipeline import Pipeline
from gleanery.sources import sinks


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
DOCX = _zip({"word/document.xml": f"<w:d {W}><w:p><w:t>One </w:t><w:t>two</w:t></w:p><w:p><w:t> </w:t></w:p><w:p><w:t>Three</w:t></w:p></w:d>", "word/media/a.png": "x"})
PPTX = _zip({f"ppt/slides/slide{i}.xml": f"<w:s {W}><w:p><w:t>S{i}</w:t></w:p></w:s>" for i in (10, 2)})
XLSX = _zip({
    "xl/sharedStrings.xml": f"<w:sst {W}><w:si><w:t>name</w:t></w:si></w:sst>",
    "xl/worksheets/sheet1.xml": f'<w:s {W}><w:row><w:c t="s"><w:v>0</w:v></w:c><w:c><w:v>5</w:v></w:c></w:row><w:row/>' + f"<w:row><w:c><w:v>1</w:v></w:c></w:row>" * 120 + "</w:s>",
})


def test_office_files(spark):
    assert office.extract("docx", DOCX) == ("One two\n\nThree", {"paragraphs": "2", "has_images": "true"})
    assert office.extract("pptx", PPTX)[0] == "Slide 1\nS2\n\nSlide 2\nS10"
    text, meta = office.extract("xlsx", XLSX)
    assert text.startswith("Sheet 1\nname\t5\n1") and text.endswith("[more rows]") and text.count("\n1") == 98 and meta == {"sheets": "1"}
    book = _zip({
        "xl/workbook.xml": f'<w:b {W} xmlns:r="urn:r"><w:sheets><w:sheet name="Zeta" r:id="b"/><w:sheet name="Alpha" r:id="a"/></w:sheets></w:b>',
        "xl/_rels/workbook.xml.rels": '<R><R Id="a" Target="worksheets/sheet1.xml"/><R Id="b" Target="/xl/worksheets/sheet2.xml"/></R>',
        "xl/worksheets/sheet1.xml": f'<w:s {W}><w:row><w:c r="B1"><w:v>1</w:v></w:c><w:c r="AA1"><w:v>2</w:v></w:c></w:row></w:s>',
        "xl/worksheets/sheet2.xml": f'<w:s {W}><w:row><w:c r="A1" t="inlineStr"><w:is><w:t>x</w:t></w:is></w:c><w:c r="C1"><w:v>3</w:v></w:c></w:row></w:s>',
    })
    assert office.extract("xlsx", book) == ("Zeta\nx\t\t3\n\nAlpha\n\t1" + "\t" * 25 + "2", {"sheets": "2"})
    assert office.extract("docx", b"no zip") == ("", {}) and office.extract("html", b"<p>a</p>")[0] == "a"
    assert office.extract("txt", "é".encode("latin-1"))[0] == "é" and office.extract(None, None) == ("", {})
    df = spark.createDataFrame([("a", "docx", bytearray(DOCX)), ("b", "txt", bytearray(b"x\x00y")), ("c", None, None)], "path string, ext string, content binary")
    got = {r["path"]: (r["text"], r["metadata"]) for r in office.with_text(df, "ext", "content").collect()}
    assert got["a"][1]["paragraphs"] == "2" and got["b"] == ("xy", {}) and got["c"] == ("", {})


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, "the quick brown fix"), (3, "zzzz"), (4, " "), (5, None)], "i int, t string")
    got = {r["i"]: r["embedding"] for r in embed.with_embedding(df, "t", embed.HashedTrigrams(32)).collect()}
    assert got[4] is None and got[5] is None and np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-5)
    assert np.dot(got[1], got[2]) > 0.6 > np.dot(got[1], got[3])
    zero = embed.with_embedding(df, "t", embed.HashedTrigrams(32), parity=True).where("i = 5").first()["embedding"]
    assert zero == [0.0] * 32


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", "Share", 5)], "path string, destination string, score int")
    sinks.write_short_report(rows, str(tmp_path / "r.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).columns == list(sinks.SHORT)
    sinks.write_reprocessing_report(rows, str(tmp_path / "q.csv"))
    assert len(spark.read.option("header", True).csv(str(tmp_path / "q.csv")).columns) == 10
    at = datetime(2024, 1, 1)
    entries = [("replies", "k", "old", 3, at, None), ("replies", "k", "new", 3, at + timedelta(days=1), None), ("replies", "x", None, 0, at, "api_error")]
    df = spark.createDataFrame(entries, "store string, key string, reply string, size_bytes long, created_at timestamp, error_type string")
    sinks.append_cache(df, str(tmp_path / "cache"))
    assert [(r["key"], r["reply"]) for r in sinks.newest_entries(spark.read.parquet(str(tmp_path / "cache"))).collect()] == [("k", "new")]
    sinks.append_version(spark.createDataFrame([("a", 1)], "name string, version int"), str(tmp_path / "v"))
    sinks.append_version(spark.createDataFrame([("a", 2)], "name string, version int"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def _odd():
    import re

    class Odd:  # local, so that it travels to the workers
        name = "odd"

        def reply(self, prompt):
            n = re.search(r"list of (\d+) objects", prompt)
            if "bad" in prompt:
                raise OSError("down")
            if "prose" in prompt:
                return "no idea"
            if "short" in prompt:
                return '[{"classification": "Share", "score": 5}]'
            if n:
                rows = ", ".join(f'{{"classification": "Share", "score": {4 if k % 2 else 5}, "rank": {int(n[1]) - k}}}' for k in range(int(n[1])))
                return f"Here: [{rows}]"
            return 'Sure: {"classification": "Share", "score": 9}'

    return Odd()


SHAPE = "item_id long, path string, media_type string, folder string, at timestamp"


def _items(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "/a/1.jpg", "image", "/a", t), (2, "/a/2.jpg", "image", "/a", t + timedelta(seconds=5)), (3, "/a/bad.jpg", "image", "/a", None), (4, "/b/prose.jpg", "image", "/b", t)]
    rows += [(5, "/c/v.mp4", "video", "/c", t), (6, "/c/n.txt", "document", "/c", None), (7, "/c/x.bin", None, "/c", t)]
    return spark.createDataFrame(rows, SHAPE)


def test_pipeline(spark):
    quick = judge.Retry(attempts=1)
    run = Pipeline(judge=_odd(), retry=quick)
    got = {r["item_id"]: r for r in run.run(_items(spark)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and [got[i]["group_size"] for i in (1, 2, 3, 4)] == [2, 2, 1, 1] and got[2]["group_id"] == 1
    assert [(got[i]["score"], got[i]["rank"], got[i]["destination"]) for i in (1, 2)] == [(5, 2, "Share"), (4, 1, "Share")]
    assert (got[3]["error_type"], got[3]["classification"], got[3]["score"], got[3]["destination"], got[3]["rank"]) == ("api_error", "Review", 2, "Review", None)
    assert got[4]["error_type"] == "invalid_response" and got[4]["is_error_fallback"] and got[4]["reasoning"].startswith("Fallback response:")
    assert (got[5]["score"], got[5]["audio_quality"], got[5]["content_summary"], got[6]["content_summary"], got[6]["audio_quality"]) == (5, "unknown", None, "", None)
    counts, top = run.report(run.run(_items(spark)))
    assert "Share: 4 (66.7%)" in sinks.summary(counts, top, 2, 1.0)
    singles, _ = run.prompts(run.group(_items(spark)))
    key = {r["item_id"]: r["key"] for r in singles.collect()}
    cached = run.run(_items(spark), spark.createDataFrame([(key[3], '{"classification": "Storage", "score": 1}')], "key string, reply string"))
    assert {r["item_id"]: (r["destination"], r["cached"]) for r in cached.collect()}[3] == ("Storage", True)
    off = Pipeline(judge=_odd(), retry=quick, config=Config.of({"bursts": {"enabled": False}, "routing": {"classify_videos": False}}))
    rest = {r["item_id"]: r for r in off.run(_items(spark)).collect()}
    assert {r["group_size"] for r in rest.values()} == {1}
    assert (rest[5]["destination"], rest[5]["is_error_fallback"], rest[5]["error_type"]) == ("Videos", False, None) and rest[1]["destination"] == "Share"


def test_groups_are_judged_in_chunks(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, f"/a/{i}.jpg", "image", "/a", t + timedelta(seconds=i)) for i in range(23)] + [(50 + i, f"/s/short{i}.jpg", "image", "/s", t) for i in range(2)]
    got = {r["item_id"]: r for r in Pipeline(judge=_odd(), retry=judge.Retry(attempts=1)).run(spark.createDataFrame(rows, SHAPE)).collect()}
    assert [got[i]["rank"] for i in range(23)] == [*range(10, 0, -1), *range(20, 10, -1), 23, 22, 21]
    assert all(got[i]["is_error_fallback"] and got[i]["error_type"] == "invalid_response" for i in (50, 51))  # one answer for two
    config = Config.of({"routing": {"ranked_bursts": True}})
    ranked = {r["item_id"]: r["destination"] for r in Pipeline(judge=_odd(), retry=judge.Retry(attempts=1), config=config).run(spark.createDataFrame(rows, SHAPE)).collect()}
    assert [i for i in range(23) if ranked[i] == "Share"] == [8, 9] and ranked[0] == "Review"


def test_documents_are_judged_with_their_like(spark):
    rows = [(1, "/d/a.txt", "document", "/d", None, "ta", [1.0, 0.0]), (2, "/d/b.txt", "document", "/d", None, "tb", [0.99, 0.05]), (3, "/d/c.txt", "document", "/d", None, "tc", [0.0, 1.0]), (4, "/d/e.txt", "document", "/d", None, None, None)]
    df = spark.createDataFrame(rows, SHAPE + ", text string, embedding array<double>")
    run = Pipeline(judge=judge.SteadyJudge(), config=Config.of({"documents": {"dim": 2}}))
    got = {r["item_id"]: r for r in run.run(df).collect()}
    assert {i: (r["group_id"], r["group_index"], r["group_size"]) for i, r in got.items()} == {1: (1, 0, 2), 2: (1, 1, 2), 3: (3, 0, 1), 4: (4, 0, 1)}
    assert (got[1]["rank"], got[2]["rank"], got[3]["rank"]) == (1, 2, None) and not any(r["is_error_fallback"] for r in got.values())
    limits = {"Share": 4, "Review": 3}
    assert all(r["destination"] == ("Review" if r["score"] < limits.get(r["classification"], 0) else r["classification"]) for r in got.values())
    _, chunks = run.prompts(run.group(df))
    prompt = chunks.first()["prompt"]
    assert "list of 2 objects" in prompt and prompt.endswith("1. /d/a.txt\nta\n2. /d/b.txt\ntb")


def test_bundles_are_judged_whole(spark):
    files = spark.createDataFrame([("x", "/x/1"), ("x", "/x/2"), ("bad", "/bad/1")], "bundle string, path string")
    got = {r["bundle"]: r for r in Pipeline(judge=_odd(), retry=judge.Retry(attempts=1)).bundles(files).collect()}
    assert (got["x"]["files"], got["x"]["score"], got["x"]["destination"]) == (2, 5, "Share")
    assert (got["bad"]["is_error_fallback"], got["bad"]["error_type"], got["bad"]["destination"]) == (True, "api_error", "Review")


def test_replies_are_asked_once(spark, tmp_path):
    folder = str(tmp_path)

    class Counting:
        name = "counting"

        def reply(self, prompt):
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            return '{"classification": "Share", "score": 4}'

    run = Pipeline(judge=Counting())
    results = run.run(_items(spark).where("item_id in (3, 4, 5)"))
    counts, top = run.report(results)
    assert counts.count() == 1 and top.count() == 3 and results.count() == 3
    assert len(list(tmp_path.iterdir())) == 3


def test_failures_are_judged_again(spark):
    quick = judge.Retry(attempts=1)
    t = datetime(2024, 1, 1)
    rows = [(1, "/a/1.jpg", "image", "/a", t), (2, "/a/2.jpg", "image", "/a", t), (3, "/b/bad.jpg", "image", "/b", t), (4, "/b/4.jpg", "image", "/b", t), (5, "/c/bad.mp4", "video", "/c", t)]
    df = spark.createDataFrame(rows, SHAPE)
    before = Pipeline(judge=_odd(), retry=quick).run(df)  # the whole burst of 3 and 4 fails, and 5
    assert {r["item_id"] for r in before.where("is_error_fallback").collect()} == {3, 4, 5}
    after = Pipeline(retry=quick).again(df, before)
    got = {r["item_id"]: r for r in after.collect()}
    assert set(got) == {3, 4, 5} and (got[3]["group_size"], got[3]["rank"], got[4]["rank"], got[5]["group_size"]) == (2, 1, 2, 1)
    partly = before.withColumn("is_error_fallback", F.col("item_id") == 3)
    assert [(r["item_id"], r["group_size"], r["rank"]) for r in Pipeline(retry=quick).again(df, partly).collect()] == [(3, 1, None)]
    row = recover.summary(before.where("is_error_fallback"), after, "item_id").first()
    assert row["rows"] == 3 and row["still_error"] == 0 and row["still_review"] + row["recovered"] == 3


def test_pairs_by_the_judges_word(spark):
    class Word:
        name = "word"

        def reply(self, prompt):
            if "down" in prompt:
                raise OSError("no answer")
            return '{"varied": false, "confidence": 0.9, "reason": "alike"}' if "same" in prompt else "?"

    df = spark.createDataFrame([(1, "same", "same"), (2, "a", "b"), (3, "down", "x")], "k int, a string, b string")
    got = {r["k"]: (r["varied"], r["confidence"], r["reason"]) for r in judge.varied_pairs(df, "k", "a", "b", Word(), judge.Retry(attempts=1)).collect()}
    assert got == {1: (False, 0.9, "alike"), 2: (True, 0.5, "no reason given"), 3: (True, 0.5, "no answer")}
    assert judge.varied_pairs(df, "k", "a", "b", Word(), enabled=False).where("varied and confidence = 0.5").count() == 3


def test_files_are_copied_and_moved(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    rows = [(str(tmp_path / n), str(tmp_path / "out" / "Share" / n)) for n in ("a", "b", "gone")]
    df = spark.createDataFrame(rows, "s string, t string")
    said = lambda move: [r["outcome"] for r in sorted(sinks.transferred(df, "s", "t", move).collect())]
    assert said(False) == ["done", "done", "missing"] and said(False) == ["there", "there", "missing"]
    assert (tmp_path / "a").exists() and said(True) == ["done", "done", "missing"] and said(True) == ["there", "there", "missing"]
    assert not (tmp_path / "a").exists() and sorted(p.name for p in (tmp_path / "out" / "Share").iterdir()) == ["a", "b"]


def test_settings_are_saved_and_loaded(tmp_path):
    config = Config.of({"routing": {"share_threshold": 5, "diversity": False}, "bursts": {"similarity": 0.9}})
    for name in ("c.yaml", "c.json"):
        settings.save(config, tmp_path / name)
        assert settings.load(tmp_path / name) == config
    (tmp_path / "d.yaml").write_text("# ours\nrouting:\n  share_threshold: 5  # strict\n  odd: 'x'\nbursts:\n  enabled: no\n")
    assert settings.load(tmp_path / "d.yaml") == Config.of({"routing": {"share_threshold": 5}, "bursts": {"enabled": False}})
    (tmp_path / "e.yaml").write_text("routing:\n  share_threshold: 9\n")
    with pytest.raises(ValueError):
        settings.load(tmp_path / "e.yaml")


def test_feedback(spark):
    t = datetime(2024, 1, 1)
    rows = [(f"f{i}", None if i == 3 else "A" if i % 2 else "B", f"r{i}" if i % 5 else " ", t + timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "file_path string, correct_category string, reasoning string, submitted_at timestamp")
    got = {r["category"]: (r["n"], r["reasons"]) for r in labels.reasons_by_category(df, 3).collect()}
    assert got == {"A": (29, ["r1", "r7", "r9"]), "B": (30, ["r2", "r4", "r6"]), "unknown": (1, ["r3"])}
    assert [r["file_path"] for r in labels.recent(df, 2).collect()] == ["f58", "f59"]
    rows = spark.createDataFrame([("x", i) for i in range(50)] + [("y", i) for i in range(4)] + [(None, 1)] * 2, "c string, i int")
    assert {r["c"]: r["count"] for r in labels.balanced_categories(rows, "c", [F.col("i")]).groupBy("c").count().collect()} == {"x": 6, "y": 4, None: 2}
    moved = spark.createDataFrame([("p", "Storage", "Share"), ("q", "Review", "Share"), ("r", "Share", "Ignore")], "n string, was string, now string")
    known = spark.createDataFrame([("p", "Storage", 3), ("z", "Ignore", 3)], "n string, category string, confidence int")
    got = {r["n"]: (r["category"], r["confidence"]) for r in labels.corrections(moved, known, "n", "was", "now").collect()}
    assert got == {"p": ("Share", 5), "q": ("Share", 4), "r": ("Ignore", 4), "z": ("Ignore", 3)}
    assert {r["direction"]: r["n"] for r in labels.threshold_advice(moved, "was", "now").collect()} == {"lower the threshold": 2, "raise the threshold": 1}
