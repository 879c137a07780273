"""Problem 8: combine sources to target shares of the total size in tokens, with capped repetition.

Method: entropy balancing. Document rates start at the plan's overall fraction and are tilted exponentially by the
document's tokens until each source's expected tokens meet its target: the convex dual has one multiplier per plan and
source, found by safeguarded Newton steps of which each is one aggregation over the counts of (source, tokens). Rates
stop at the source's cap. They are rounded into copies token count by token count, what is left over carried on in
tokens, and given to the documents of one token count in the order of their hash.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.truncation import source_name
from gleanery.operators.ranking import global_rank
from gleanery.scratch import Scratch

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public splitting pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(df: DataFrame, text_col: str, out: str = "tokens", ranks: str = RANKS) -> DataFrame:
    """``df`` without the text, with its number of tokens: 0 for null and empty texts; special strings are text; bytes that
    are no UTF-8 count as the mark of replacement."""
    shape = ", ".join([*(f"`{n}` {t}" for n, t in df.drop(text_col).dtypes), f"`{out}` long"])
    names = [n for n in df.columns if n != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        code = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for b in batches:
            n = [len(code.encode_ordinary(t.decode("utf-8", "replace"))) if t else 0 for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64())], [*names, out])

    return df.withColumn(text_col, F.col(text_col).cast("binary")).mapInArrow(run, shape)


def _tilts(spark: SparkSession, counts: DataFrame, plans: dict[tuple, dict], rounds: int = 60, close: float = 1e-7) -> None:
    """Solves every plan's and source's multiplier in place: plans[(plan, source)] has base, cap, target, mean, and
    gets tilt. Rates are min(cap, base * exp(tilt * tokens / mean)). The plan table bounds what the driver holds."""
    for v in plans.values():
        v |= {"tilt": 0.0, "low": -math.inf, "high": math.inf, "open": v["mean"] > 0 and v["target"] > 0}
        if v["mean"] > 0 and v["target"] >= v["cap"] * v["tokens"]:
            v |= {"tilt": math.inf, "open": False}  # all copies there are
        elif v["target"] <= 0:
            v |= {"tilt": -math.inf, "open": False}
    for _ in range(rounds):
        todo = [(p, s, v["base"], v["cap"], v["mean"], v["tilt"]) for (p, s), v in plans.items() if v["open"]]
        if not todo:
            return
        asked = spark.createDataFrame(todo, "plan string, source string, base double, cap double, mean double, tilt double")
        x = F.col("tokens") / F.col("mean")
        power = F.ln("base") + F.col("tilt") * x
        held = power >= F.ln("cap")
        rate = F.when(held, F.col("cap")).otherwise(F.exp(F.least(power, F.ln("cap"))))
        got = counts.join(F.broadcast(asked), "source").groupBy("plan", "source").agg(  # rows of the plan table
            F.sum(F.col("n") * F.col("tokens") * rate).alias("sum"),
            F.sum(F.when(held, 0.0).otherwise(F.col("n") * F.col("tokens") * x * rate)).alias("slope"),
        )
        for r in got.collect():  # rows of the plan table
            v = plans[(r["plan"], r["source"])]
            miss = v["target"] - r["sum"]
            if abs(miss) <= close * v["target"]:
                v["open"] = False
                continue
            v["low" if miss > 0 else "high"] = v["tilt"]
            step = max(-3.0, min(3.0, miss / r["slope"])) if r["slope"] > 0 else math.copysign(3.0, miss)
            new = v["tilt"] + step
            if not v["low"] < new < v["high"]:
                new = (v["low"] + v["high"]) / 2
            if new == v["tilt"]:
                v["open"] = False
            v["tilt"] = new


def _rounded(table: pa.Table) -> pa.Table:
    """Whole copies m for one plan and source, whose rows are its token counts (as many as texts differ in length).
    From the longest to the shortest, what rounding adds or leaves is carried on, in tokens."""
    table = table.sort_by([("tokens", "descending")])
    carry, m = 0.0, []
    columns = (table[c].to_pylist() for c in ("tokens", "n", "cap", "due"))
    for tokens, n, cap, due in zip(*columns):
        carry += due * tokens
        k = int(max(0, min(n * cap, math.floor(carry / tokens + 0.5)))) if tokens else 0
        carry -= k * tokens
        m.append(k)
    return pa.table({**{c: table[c] for c in ("plan", "source", "tokens", "n")}, "m": pa.array(m, pa.int64())})


def mixture(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, plans: DataFrame, ranks: str = RANKS, max_plan_rows: int = 10_000
) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) for plans (plan_name, source, target_share, max_repeats, total_fraction).

    copies: (plan, id, source, tokens, copies) for every document that a plan uses. shares: (plan, source, target_share,
    target_tokens, documents, used, most_copies, tokens, share_of_plan, share_reached, short) for every row of a plan;
    short tells that the cap on repeats keeps the source below its target.

    Sources in several writings are one, a null source is none; null and empty texts have no tokens and are not used;
    a source without documents gets nothing; repeated plan rows count once; repeated ids are documents of their own;
    an empty table gives empty copies and all sources short. Extra columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    base = docs.select(
        F.col(id_col).alias("id"), source_name(F.col(source_col)).alias("source"), F.col(text_col).alias("text")
    )
    sized = scratch.keep(count_tokens(base, "text", ranks=ranks))
    counts = scratch.keep(sized.where("source is not null").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    rows = plans.select(
        F.col("plan_name").alias("plan"), source_name(F.col("source")).alias("source"), "target_share", "max_repeats", "total_fraction"
    ).distinct()
    per = counts.groupBy("source").agg(
        F.sum(F.col("n") * F.col("tokens")).alias("held"), F.sum(F.when(F.col("tokens") > 0, F.col("n")).otherwise(0)).alias("docs")
    )
    table = rows.join(per, "source", "left").limit(max_plan_rows + 1).collect()
    if len(table) > max_plan_rows:
        raise ValueError(f"more than {max_plan_rows} plan rows")
    solved: dict[tuple, dict] = {}
    for r in table:
        share, fraction = r["target_share"] or 0.0, r["total_fraction"] or 0.0
        cap, held, n = float(r["max_repeats"] or 0), float(r["held"] or 0), r["docs"] or 0
        solved[(r["plan"], r["source"])] = {
            "base": max(min(fraction, cap), 1e-9), "cap": cap, "target": share * fraction * total if cap > 0 else 0.0,
            "tokens": held, "mean": held / n if n else 0.0, "share": share, "want": share * fraction * total, "docs": n,
        }
    _tilts(spark, counts, solved)
    done = [
        (p, s, v["base"], v["cap"], v["mean"] or 1.0, max(-1e6, min(1e6, v["tilt"])), v["share"], v["want"], v["docs"])
        for (p, s), v in solved.items()
    ]
    shape = "plan string, source string, base double, cap double, mean double, tilt double, target_share double, target_tokens double, documents long"
    rates = spark.createDataFrame(done, shape)
    power = F.ln("base") + F.col("tilt") * F.col("tokens") / F.col("mean")
    rate = F.when((F.col("cap") <= 0) | (F.col("tokens") == 0), 0.0).otherwise(F.exp(F.least(power, F.ln("cap"))))
    cells = counts.join(F.broadcast(rates.select("plan", "source", "base", "cap", "mean", "tilt")), "source")
    cells = cells.select("plan", "source", "tokens", "n", "cap", (F.col("n") * rate).alias("due"))
    whole = cells.groupBy("plan", "source").applyInArrow(_rounded, "plan string, source string, tokens long, n long, m long")
    cells = scratch.keep(whole.where("m > 0"))
    used = sized.join(rows.select("source").distinct(), "source", "left_semi").where("tokens > 0")
    ranked = global_rank(used, [F.col("source"), F.col("tokens"), F.xxhash64("id"), F.col("id")], "place")
    ranked = scratch.keep(ranked)
    starts = ranked.groupBy("source", "tokens").agg(F.min("place").alias("start"))
    given = cells.join(starts, ["source", "tokens"])
    spread = F.floor(F.col("m") / F.col("n")) + F.when(F.col("place") - F.col("start") < F.col("m") % F.col("n"), 1).otherwise(0)
    copies = ranked.join(given, ["source", "tokens"]).select("plan", "id", "source", "tokens", spread.cast("long").alias("copies"))
    copies = copies.where("copies > 0")
    reached = cells.groupBy("plan", "source").agg(
        F.sum(F.col("m") * F.col("tokens")).alias("tokens"), F.sum(F.least("m", "n")).alias("used"),
        F.max(F.ceil(F.col("m") / F.col("n"))).alias("most_copies"),
    )
    shares = rates.join(reached, ["plan", "source"], "left").na.fill(0, ["tokens", "used", "most_copies"])
    plan = Window.partitionBy("plan")  # the sources of a plan
    shares = shares.withColumn("sum", F.sum("tokens").over(plan)).withColumn("goal", F.sum("target_tokens").over(plan))
    shares = shares.select(
        "plan", "source", "target_share", F.round("target_tokens", 3).alias("target_tokens"), "documents", "used", "most_copies", "tokens",
        F.round(F.col("tokens") / F.nullif("goal", F.lit(0)), 6).alias("share_of_plan"),
        F.round(F.col("tokens") / F.nullif("sum", F.lit(0)), 6).alias("share_reached"),
        (F.col("target_tokens") - F.col("tokens") > F.greatest(F.lit(1.0), 0.01 * F.col("target_tokens"))).alias("short"),
    )
    return copies, shares


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixture(docs, "doc_id", "text", "source", spark.read.parquet(f"{sf_dir}/mix_targets.parquet"))


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each plan uses each document; documents that are not listed are not used."""
    copies, _ = _run(spark, sf_dir)
    return copies.select(F.col("plan").alias("plan_name"), F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of each plan: asked for and reached."""
    return _run(spark, sf_dir)[1].withColumnRenamed("plan", "plan_name")
