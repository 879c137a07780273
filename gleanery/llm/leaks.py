"""Problem 7: evaluation texts leaking into training text.

Method: greedy string tiling. Documents and test items that share a seed (a run of words, joined by hash) are tiled:
the longest run of words that both have and that no tile covers yet becomes a tile, again and again until none of the
least length is left. Runs are found by Karp-Rabin hashes of a length that starts long and is lowered step by step. The
share of the item that the tiles cover tells how much leaked, in whatever order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import word_hashes
from gleanery.scratch import Scratch


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def _rolling(w: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2^64, odd base) of all runs of n words, from prefix sums; the base's inverse takes the
    place of a run out of its hash."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    up = np.cumprod(np.r_[np.uint64(1), np.full(len(w) - 1, np.uint64(_BASE))])
    down = np.cumprod(np.r_[np.uint64(1), np.full(len(w) - n, np.uint64(_BACK))])
    prefix = np.r_[np.uint64(0), np.cumsum(w * up)]
    return (prefix[n:] - prefix[:-n]) * down


def _free(taken: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of n words from each place is uncovered."""
    c = np.r_[0, np.cumsum(taken)]
    return c[n:] == c[:-n]


def _common(doc: np.ndarray, item: np.ndarray, least: int, most: int) -> list[tuple[int, int, int]] | None:
    """(item start, doc start, length) of the maximal common runs of at least ``least`` words; None if the places of
    such runs are more than ``most`` (texts that repeat themselves)."""
    hd, hi = _rolling(doc, least), _rolling(item, least)
    keep = np.flatnonzero(np.isin(hd, hi))
    order = np.argsort(hi, kind="stable")
    low, high = (np.searchsorted(hi[order], hd[keep], side) for side in ("left", "right"))
    count = high - low
    if count.sum() > most:
        return None
    d = np.repeat(keep, count)
    i = order[np.repeat(low, count) + np.arange(len(d)) - np.repeat(np.cumsum(count) - count, count)]
    same = np.ones(len(d), bool)
    for k in range(least):
        same &= doc[d + k] == item[i + k]
    d, i = d[same], i[same]
    order = np.lexsort((d, d - i))
    d, i = d[order], i[order]
    first = np.ones(len(d), bool)
    first[1:] = (np.diff(d - i) != 0) | (np.diff(d) != 1)  # a run goes on along its diagonal
    start = np.flatnonzero(first)
    length = np.diff(np.r_[start, len(d)]) + least - 1
    return list(zip(i[start].tolist(), d[start].tolist(), length.tolist()))


def tiles(doc: np.ndarray, item: np.ndarray, least: int, most: int = 5_000_000) -> list[tuple[int, int, int]]:
    """(item start, doc start, length) of the greedy tiles of at least ``least`` words, longest first; ties go to the
    earlier place in the item, then in the document. Common runs are found once and kept by length; what a tile takes of
    them is cut off when they are next looked at. Texts with more than ``most`` places of common runs are tiled by
    looking for the longest run again and again, with the same result in less memory."""
    doc, item = doc.astype(np.uint64), item.astype(np.uint64)
    runs = _common(doc, item, least, most)
    if runs is None:
        return _tiles_by_search(doc, item, least)
    used_d, used_i = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    found: list[tuple[int, int, int]] = []
    heap = [(-n, i, d) for i, d, n in runs]
    heapq.heapify(heap)
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        taken = used_i[i : i + n] | used_d[d : d + n]
        if not taken.any():
            used_i[i : i + n] = True
            used_d[d : d + n] = True
            found.append((i, d, n))
            continue
        edge = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # the free pieces
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, d + a))
    return found


def _tiles_by_search(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    known = np.isin(doc, item)
    if not known.any():
        return []
    used_d, used_i = ~known, np.zeros(len(item), bool)
    found: list[tuple[int, int, int]] = []

    def longest(n: int) -> tuple[int, int, int] | None:
        """A longest common free run of at least n words, by doubling and halving its length."""
        low, high, best = n, None, None
        size = n
        while True:
            hit = match(size)
            if hit:
                best, low = (hit[0], hit[1], size), size
                size = size * 2 if high is None else (low + high) // 2
            else:
                high = size
                size = (low + high) // 2
            size = min(size, len(item), len(doc))
            if high is not None and high - low <= 1 or best and size == best[2]:
                return best
            if best is None:
                return None

    def match(n: int) -> tuple[int, int] | None:
        if n > len(item) or n > len(doc):
            return None
        hi, hd = _rolling(item, n), _rolling(doc, n)
        pi, pd = np.flatnonzero(_free(used_i, n)), np.flatnonzero(_free(used_d, n))
        if not len(pi) or not len(pd):
            return None
        keys, first = np.unique(hd[pd], return_index=True)
        at = np.searchsorted(keys, hi[pi])
        at[at == len(keys)] = 0
        for k in np.flatnonzero(keys[at] == hi[pi]):
            i, d = int(pi[k]), int(pd[first[at[k]]])
            if np.array_equal(item[i : i + n], doc[d : d + n]):
                return i, d
        return None

    while (got := longest(least)) is not None:
        i, d, n = got
        used_i[i : i + n] = True
        used_d[d : d + n] = True
        found.append((i, d, n))
    return found


_SHAPE = "doc {doc}, item {item}, longest int, covered int, tiles int, item_words int"


def _measured(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    return max((n for *_, n in found), default=0), sum(n for *_, n in found), len(found)


def _tiled(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [
                _measured(tiles(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), least))
                for x, y in zip(b.column("doc_words"), b.column("item_words"))
            ]
            words = b.column("item_words").value_lengths()
            columns = [pa.array([g[k] for g in got], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("item"), *columns, words.cast(pa.int32())],
                ["doc", "item", "longest", "covered", "tiles", "item_words"],
            )

    return run


class _Items:
    """The test items as arrays, for a number of seeds that was checked: their words one after another, and the places of
    their seeds sorted by hash."""

    def __init__(self, table: pa.Table, seed: int):
        words = table["words"].combine_chunks()
        self.ids, self.seed = table["id"].combine_chunks(), seed
        self.words = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        self.size = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]
        place = np.arange(max(0, len(self.words) - seed + 1))
        item = np.repeat(np.arange(len(self.size)), self.size)[: len(place)]
        whole = place + seed <= self.start[item + 1]
        h, place, item = _rolling(self.words, seed)[whole], place[whole], item[whole]
        order = np.argsort(h, kind="stable")
        self.hashes, self.place, self.item = h[order], place[order], item[order]

    def of(self, k: int) -> np.ndarray:
        return self.words[self.start[k] : self.start[k + 1]]

    def met(self, words: np.ndarray, size: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, place) once for every seed of an item that a row's words hold at an every-th place."""
        none = np.zeros(0, np.int64)
        if len(words) < self.seed or not len(self.hashes):
            return none, none, none
        end = np.cumsum(size)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(words) - self.seed + 1)
        row = row[: len(at)]
        at = at[(at + self.seed <= end[row]) & ((at - (end - size)[row]) % every == 0)]
        h = _rolling(words, self.seed)[at]
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        hit = np.flatnonzero(high > low)
        # a seed that a row holds many times counts once
        pairs = np.unique(np.stack([row[at[hit]], low[hit], high[hit]]), axis=1)
        count = pairs[2] - pairs[1]
        k = np.repeat(pairs[1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(pairs[0], count), self.item[k], self.place[k]


def _one_pass(known, every: int, least: int, enough):
    """Documents' words -> the tiled pairs: seeds, the rule that admits a pair and the tiles in one reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = known.value
        for b in batches:
            column = b.column("words")
            words = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            row, item, _ = items.met(words, size, every)
            key, count = np.unique(np.stack([row, item]), axis=1, return_counts=True)
            ok = enough(count, items.size[key[1]])
            row, item = key[0][ok], key[1][ok]
            got = [_measured(tiles(words[start[r] : start[r] + size[r]], items.of(k), least)) for r, k in zip(row, item)]
            columns = [pa.array([g[k] for g in got], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row)), items.ids.take(pa.array(item)), *columns, pa.array(items.size[item].astype(np.int32))],
                ["doc", "item", "longest", "covered", "tiles", "item_words"],
            )

    return run


def leaks(
    docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, run: int = 10,
    tile: int = 5, seed: int = 8, broadcast_seeds: int = 500_000, share: float | None = None,
) -> DataFrame:
    """(doc, item, longest, covered, tiles, item_words) for every document and item with a common run of ``run``
    words: the longest tile, the item's words covered by tiles of ``tile`` words or more, their number, its length.

    Seeds of ``seed`` words lie at every place of an item and at every (run - seed + 1)-th place of a document, which
    every common run of ``run`` words contains; so nothing is missed and few seeds are joined. The items' words, as many
    as their seeds, are counted: up to ``broadcast_seeds`` of them the items are broadcast, and documents are read once
    and not shuffled; beyond that seeds are joined by a shuffle, and only documents that hold one are read again.

    With ``share``, pairs whose tiles cover that share of the item are found too, in whatever order and however short the
    tiles: the seeds are then runs of ``tile`` words at every place of both. A tile of n words holds n - tile + 1 seeds, so
    pairs with too few seeds of the item in common for either rule are left untiled; none is lost by that.

    Null, empty and shorter texts match nothing; repeated rows count once (rows of one id with different texts each
    count); very long texts are taken whole; empty tables give an empty result; extra columns are ignored.
    """
    if share is not None:
        seed = tile
    if not 0 < seed <= run:
        raise ValueError("seed must be in 1..run")
    step, least = (run - seed + 1, run) if share is None else (1, tile)
    scratch = Scratch(docs.sparkSession)

    def worded(df: DataFrame, key: str, text: str) -> DataFrame:
        rows = df.select(F.col(key).alias("id"), word_hashes(F.col(text)).alias("words"))
        return rows.where((F.size("words") >= least) & F.col("id").isNotNull())

    def seeds(rows: DataFrame, every: int, name: str) -> DataFrame:
        starts = F.sequence(F.lit(1), F.size("words") - seed + 1, F.lit(every))
        found = F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, seed)))
        return rows.select(F.col("id").alias(name), F.posexplode(F.array_distinct(found) if share is not None and name == "doc" else found).alias("place", "seed"))

    test, corpus = worded(items, item_id, item_text), worded(docs, doc_id, doc_text)
    kinds = {"doc": dict(corpus.dtypes)["id"], "item": dict(test.dtypes)["id"]}
    long = F.col("longest") >= run
    wanted = long if share is None else long | (F.col("covered") >= F.col("item_words") * share)
    if (test.agg(F.sum(F.size("words"))).first()[0] or 0) <= broadcast_seeds:
        enough = (
            (lambda count, size: count > 0) if share is None
            else (lambda count, size: (count * tile >= size * share) | (count > run - tile))
        )
        held = test.distinct().toArrow()
        known = docs.sparkSession.sparkContext.broadcast(_Items(held, seed))
        tiled = corpus.mapInArrow(_one_pass(known, step, tile, enough), _SHAPE.format(**kinds))
        return tiled.where(wanted).distinct()
    asked = scratch.keep((seeds(test, 1, "item").drop("place") if share is None else seeds(test, 1, "item")).distinct())
    met = seeds(corpus, step, "doc").drop("place").join(asked, "seed")
    if share is None:
        met = met.select("doc", "item").distinct()
    else:
        sizes = test.groupBy(F.col("id").alias("item")).agg(F.min(F.size("words")).alias("n"))
        common = met.select("doc", "item", "place").distinct().groupBy("doc", "item").agg(F.count(F.lit(1)).alias("c"))
        enough = (F.col("c") * tile >= F.col("n") * share) | (F.col("c") > run - tile)
        met = common.join(sizes, "item").where(enough).select("doc", "item")
    met = scratch.keep(met)
    held = corpus.join(met.select(F.col("doc").alias("id")).distinct(), "id", "left_semi")
    pairs = met.join(held.toDF("doc", "doc_words"), "doc").join(test.toDF("item", "item_words"), "item")
    pairs = pairs.select("doc", "item", "doc_words", "item_words")
    return pairs.mapInArrow(_tiled(tile), _SHAPE.format(**kinds)).where(wanted).distinct()


def _run(spark: SparkSession, sf_dir: str, share: float | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/eval_items.parquet").select("item_id", "text")
    return leaks(docs, "doc_id", "text", items, "item_id", "text", share=share)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents and items that share at least ten consecutive words."""
    return _run(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each leaked item each document covers: pairs with ten consecutive words in common, or with tiles of five
    words or more over half of the item. An item is leaked whole where tiles cover 80 % of it."""
    share = F.col("covered") / F.col("item_words")
    return _run(spark, sf_dir, 0.5).select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "longest", "tiles",
        F.round(share, 6).alias("coverage"), (share >= 0.8).alias("whole"),
    )
