"""The judge: an opaque scoring function behind one interface, run in Arrow batches with retries and a cache.

A judge must be idempotent, since Spark may run a task again. The default judge is deterministic and needs no network.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Judge(Protocol):
    """One reply for one prompt, as text (JSON, fenced or not). Raises on failure."""

    name: str

    def reply(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class SteadyJudge:
    """Judges by a hash of the prompt: the same prompt always gets the same judgement. A prompt that asks for a list of n
    objects gets n judgements, by hashes of the prompt and the number, with ranks from 1."""

    name: str = "steady"
    categories: tuple[str, ...] = ("Share", "Storage", "Review", "Ignore")

    def reply(self, prompt: str) -> str:
        asked = re.search(r"\blist of (\d+) objects\b", prompt)
        if asked is None:
            return self._one(prompt)
        return "[" + ", ".join(self._one(f"{prompt}#{k}", k) for k in range(1, int(asked.group(1)) + 1)) + "]"

    def _one(self, text: str, rank: int | None = None) -> str:
        h = hashlib.sha256(text.encode()).digest()
        place = "" if rank is None else f', "rank": {rank}'
        return f'{{"classification": "{self.categories[h[0] % len(self.categories)]}", "score": {h[1] % 5 + 1}{place}, "reasoning": "hash {h[2]}"}}'


@dataclass(frozen=True)
class Retry:
    """attempts in all, with a delay that doubles, for the given kinds of error only."""

    attempts: int = 3
    delay: float = 2.0
    kinds: tuple[str, ...] = ("api_error", "invalid_response")
    sleep: Callable[[float], None] = time.sleep


def ask(judge: Judge, prompt: str, retry: Retry, usable: Callable[[str], bool] = lambda r: bool(r and r.strip())) -> tuple[str | None, str | None, str | None, int]:
    """(reply, error type, error message, retries). Never raises."""
    kind, message = None, None
    for attempt in range(retry.attempts):
        try:
            reply = judge.reply(prompt)
            if usable(reply):
                return reply, None, None, attempt
            kind, message = "invalid_response", "no usable reply"
        except Exception as error:
            kind, message = "api_error", str(error)
        if kind not in retry.kinds or attempt + 1 == retry.attempts:
            return None, kind, message, attempt
        retry.sleep(retry.delay * 2**attempt)
    return None, kind, message, max(0, retry.attempts - 1)


def judged(df: DataFrame, key: str, prompt: str, judge: Judge, retry: Retry = Retry(), workers: int = 10) -> DataFrame:
    """(key, reply, error_type, error_message, retry_count) for every row: one prompt, one reply. A task has up to
    ``workers`` requests under way at a time; a judge must bear that, or be asked with workers=1."""
    kind = dict(df.dtypes)[key]

    def one(text: object) -> tuple[str | None, str | None, str | None, int]:
        return ask(judge, text, retry) if isinstance(text, str) else (None, "load_error", "no prompt", 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for b in batches:
                got = list(pool.map(one, b[prompt]) if workers > 1 else map(one, b[prompt]))
                out = pd.DataFrame(got, columns=["reply", "error_type", "error_message", "retry_count"])
                out.insert(0, key, b[key].to_numpy())
                yield out

    shape = f"`{key}` {kind}, reply string, error_type string, error_message string, retry_count int"
    return df.select(key, prompt).mapInPandas(run, shape)


def group_prompts(df: DataFrame, group: str | list[str], position: str, line: str, chunk: int = 10) -> DataFrame:
    """(group, chunk, prompt, members): one prompt per chunk of a group, its lines in the order of position. A chunk is
    bounded, so groups of any size are fine."""
    part = F.floor(F.col(position) / chunk).cast("int").alias("chunk")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(line).alias("l")))), lambda x: x["l"])
    by = [group] if isinstance(group, str) else group
    return df.groupBy(*by, part).agg(F.array_join(lines, "\n").alias("prompt"), F.count(F.lit(1)).alias("members"))


def with_cache(df: DataFrame, cache: DataFrame, key: str, prompt: str, judge: Judge, retry: Retry = Retry(), workers: int = 10) -> DataFrame:
    """Replies from ``cache`` (key, reply) where there are, from the judge otherwise; ``cached`` tells which. Failures
    carry no reply and should not be written to the cache."""
    hits = df.select(key).join(cache.select(key, "reply"), key).select(
        key, "reply", F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_message"),
        F.lit(0).alias("retry_count"), F.lit(True).alias("cached"),
    )
    misses = df.join(cache.select(key), key, "left_anti")
    return hits.unionByName(judged(misses, key, prompt, judge, retry, workers).withColumn("cached", F.lit(False)))


def varied_pairs(pairs: DataFrame, key: str, first: str, second: str, judge: Judge, retry: Retry = Retry(), enabled: bool = True) -> DataFrame:
    """(key, varied, confidence, reason) by the judge's word on two texts each: whether both are worth showing. Without
    the check, and where the judge fails or cannot be read, pairs are varied, with a confidence of 0.5."""
    from gleanery.operators.validate import lenient_json

    if not enabled:
        return pairs.select(key, F.lit(True).alias("varied"), F.lit(0.5).alias("confidence"), F.lit("diversity is not checked").alias("reason"))
    ask_ = F.concat(
        F.lit('Do these two items differ enough to show both? Answer with a JSON object with varied, confidence and reason.\n\nFirst: '),
        F.col(first), F.lit("\n\nSecond: "), F.col(second),
    )
    replies = judged(pairs.select(key, ask_.alias("prompt")), key, "prompt", judge, retry)
    j = lenient_json(F.col("reply"))
    return replies.select(
        key, F.coalesce(F.try_variant_get(j, "$.varied", "boolean"), F.lit(True)).alias("varied"),
        F.coalesce(F.try_variant_get(j, "$.confidence", "double"), F.lit(0.5)).alias("confidence"),
        F.coalesce(F.try_variant_get(j, "$.reason", "string"), F.col("error_message"), F.lit("no reason given")).alias("reason"),
    )


def spread(groups: DataFrame, replies: DataFrame, group: str | list[str], position: str, listed: str, out: str = "judgement") -> DataFrame:
    """Members joined with their judgement by position: replies holds one array per group (and chunk). Members beyond
    the array get null."""
    by = [group] if isinstance(group, str) else group
    flat = replies.select(*by, F.posexplode(listed).alias(position, out))
    return groups.join(flat, [*by, position], "left")


def bundle_prompts(files: DataFrame, bundle: str, path: str, line: str, most: int = 10_000) -> DataFrame:
    """(bundle, files, prompt): one prompt per bundle from its first ``most`` files by path and the number of all; no
    more than that is gathered for a bundle."""
    from pyspark.sql.window import Window

    salted = Window.partitionBy(bundle, F.pmod(F.xxhash64(path), F.lit(16))).orderBy(path)
    whole = Window.partitionBy(bundle).orderBy(path)
    n = files.groupBy(bundle).agg(F.count(F.lit(1)).alias("files"))
    first = files.withColumn("__r", F.row_number().over(salted)).where(F.col("__r") <= most)
    first = first.withColumn("__r", F.row_number().over(whole)).where(F.col("__r") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(line).alias("l")))), lambda x: x["l"])
    text = first.groupBy(bundle).agg(F.array_join(lines, "\n").alias("text"))
    more = F.when(F.col("files") > most, F.concat(F.lit("\n(+"), (F.col("files") - most).cast("string"), F.lit(" more)"))).otherwise("")
    return n.join(text, bundle).select(bundle, "files", F.concat("text", more).alias("prompt"))
