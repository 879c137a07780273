"""Labels, balance, sessions, evictions, streams and the queries themselves."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanery.operators import labels, stats
from gleanery.plans import queries
from gleanery.streaming import bursts

SF = "/root/testdata/sf0.001"


def test_labels(spark):
    rows = [("a", "b", "left"), ("b", "c", "right"), ("b", "d", "both"), ("e", "f", "neither"), ("e", "e", None)]
    df = spark.createDataFrame(rows, "x string, y string, c string")
    got = {r["item"]: (r["side"], r["confidence"]) for r in labels.labels(df, "x", "y", "c").collect()}
    assert got == {"a": ("share", 0.95), "b": ("share", 0.9), "c": ("share", 0.95), "d": ("share", 0.9), "e": ("storage", 0.9), "f": ("storage", 0.9)}
    clean = spark.createDataFrame([(" LEFT ",), ("skip",), (None,)], "c string").select(labels.clean_choice(F.col("c"))).collect()
    assert [r[0] for r in clean] == ["left", None, None]
    votes = spark.createDataFrame([("p", "share", 0.8), ("p", "storage", 0.9), ("q", "share", 0.9), ("q", "storage", 0.9)], "item string, side string, conf double")
    assert {r["item"]: r["side"] for r in labels.resolve(votes).collect()} == {"p": "storage", "q": "share"}


def test_galleries(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0, 2]), (["a"], None)], "photos array<string>, s array<int>")
    got = {r["item"]: (r["side"], r["confidence"]) for r in labels.gallery_labels(df, "photos", "s").collect()}
    assert got == {"a": ("share", 0.95), "b": ("storage", 0.85), "c": ("share", 0.95)}


def test_balance(spark):
    rows = [("s", "share", 0.9)] + [(f"t{i}", "storage", i / 10) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "item string, side string, confidence double")
    assert {r["item"] for r in labels.balanced(df).collect()} == {"s", "t10", "t9", "t8"}
    assert labels.balanced(df.where("side = 'storage'")).count() == 10
    reasons = spark.createDataFrame([(i,) for i in range(10)], "i int")
    assert sorted(r["i"] for r in labels.evenly(reasons, [F.col("i")], 4).collect()) == [0, 2, 5, 7]
    assert labels.evenly(reasons, [F.col("i")], 20).count() == 10


def test_session_stats(spark):
    pairs = spark.createDataFrame([("s", "a", "b", "left", "within_burst"), ("s", "a", "c", "both", "between_burst"), ("s", "x", "y", None, "within_burst")],
                                  "session_id string, photo_a string, photo_b string, choice string, comparison_type string")
    sessions = spark.createDataFrame([("s", 8), ("t", None)], "session_id string, total_files long")
    got = {r["session_id"]: r for r in labels.session_stats(pairs, sessions, ready_at=2).collect()}
    assert (got["s"]["labelled"], got["s"]["coverage"], got["s"]["ready"], got["s"]["within_burst"]) == (3, 37.5, True, 1)
    assert (got["t"]["labelled"], got["t"]["coverage"], got["t"]["ready"]) == (0, 0.0, False)


def test_eviction(spark):
    files = spark.createDataFrame([(i, 10, T) for i, T in enumerate([datetime(2024, 1, 1) + timedelta(days=d) for d in range(10)])], "k int, size long, at timestamp")
    assert {r["k"] for r in stats.evict(files, "size", "at", "k", 50).where("evicted").collect()} == {0, 1, 2, 3, 4, 5}
    assert stats.evict(files, "size", "at", "k", 100).where("evicted").count() == 0


def test_merged_counts(spark):
    a = stats.counts(spark.createDataFrame([("x",), ("x",), (None,)], "d string"), "d", "none")
    assert {r["d"]: (r["n"], r["percent"]) for r in a.collect()} == {"x": (2, 66.6667), "none": (1, 33.3333)}
    assert {r["d"]: r["n"] for r in stats.merge_counts(a, a, by="d").collect()} == {"x": 4, "none": 2}


def test_stream_drops_nothing_before_the_watermark(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, t), (1, t + timedelta(seconds=10)), (1, t + timedelta(seconds=30)), (2, t), (3, t + timedelta(days=2))]
    spark.createDataFrame(rows, "u int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, ts timestamp").parquet(str(tmp_path / "in"))
    got = bursts.run_available(bursts.stream_sessions(stream, "u", "ts")).collect()
    assert sorted((r["u"], r["items"]) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and sum(r["n"] for r in rows) > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    """Every core query on the smallest tables; against DuckDB where there is SQL."""
    df = queries.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in queries.ORACLES:
        assert rows
        return
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    db = duckdb.connect()
    db.execute("set timezone='UTC'")
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    found = db.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return str(v).replace("+00:00", "") if hasattr(v, "isoformat") else str(v) if isinstance(v, list) else v

    key = lambda r: str(sorted(r.items()))
    want = sorted(({n: plain(v) for n, v in zip(names, r)} for r in found.fetchall()), key=key)
    assert sorted(({n: plain(v) for n, v in r.items()} for r in rows), key=key) == want
