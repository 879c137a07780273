"""The way of a collection in one plan: scan, group, judge items and groups, validate, route, count."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import prompts
from gleanery.operators import grouping, judge as judging, route, stats, validate
from gleanery.operators.judge import Judge, Retry, SteadyJudge
from gleanery.operators.ordered import Ordered
from gleanery.plans.config import Config
from gleanery.scratch import Scratch

SIMPLE = {
    "name": "simple", "categories": [{"name": n} for n in ("Share", "Storage", "Review", "Ignore")], "default_category": "Review",
    "thresholds": {"Share": 4, "Review": 3},
}
KINDS = ("image", "video", "audio", "document")
#: A category by a threshold of the profile; the other kinds take the cascade for single items.
BY_THRESHOLD = ("document", "audio")


@dataclass(frozen=True)
class Pipeline:
    """Each stage is a DataFrame -> DataFrame function and can be replaced. items: item_id, path, media_type, folder, at
    (timestamp), and text and embedding where there are; items of another media_type are left out.

    Images are grouped by time and, with vectors, by similarity; documents by similarity; the others stand alone. Groups
    are judged in chunks, members against each other, and ranked; what stands alone is judged alone, by a prompt of its
    kind. Documents and audio are routed by the profile's thresholds, the others by the cascade for single items, or,
    with routing.ranked_bursts, members of groups by rank and diversity. Videos are set aside unjudged where
    routing.classify_videos is off."""

    profile: dict = field(default_factory=lambda: SIMPLE)
    judge: Judge = field(default_factory=SteadyJudge)
    config: Config = field(default_factory=Config)
    retry: Retry | None = None

    @property
    def _retry(self) -> Retry:
        return self.retry or Retry(attempts=self.config.routing.retries + 1, delay=self.config.routing.retry_delay)

    @property
    def _names(self) -> list[str]:
        return [c["name"] for c in self.profile["categories"]]

    # ------------------------------------------------------------------------------------------ groups

    def group(self, items: DataFrame) -> DataFrame:
        """Items with group_id, group_index and group_size."""
        alone = {"group_id": F.col("item_id"), "group_index": F.lit(0), "group_size": F.lit(1)}
        images, documents = items.where("media_type = 'image'"), items.where("media_type = 'document'")
        rest = items.where(F.col("media_type").isin("video", "audio")).withColumns(alone)
        return self._bursts(images, alone).unionByName(self._similar(documents, alone)).unionByName(rest)

    def _bursts(self, images: DataFrame, alone: dict[str, Column]) -> DataFrame:
        b = self.config.bursts
        if not b.enabled:
            return images.withColumns(alone)
        grouped = grouping.sessions(images.where("at is not null"), ["folder"], "at", "item_id", b.window_seconds)
        if "embedding" in images.columns:
            found = grouping.similar_bursts(grouped, "item_id", "embedding", "at", b.similarity, b.least, b.most)
            found = found.toDF("item_id", "group_id", "group_index", "group_size")
            grouped = grouped.drop("group_id", "group_index", "group_size").join(found, "item_id")
        return grouped.unionByName(images.where("at is null").withColumns(alone))

    def _similar(self, documents: DataFrame, alone: dict[str, Column]) -> DataFrame:
        d = self.config.documents
        if not d.grouping or "embedding" not in documents.columns:
            return documents.withColumns(alone)
        found = grouping.similarity_components(documents.select("item_id", "embedding"), "item_id", "embedding", d.dim, d.similarity)
        placed = Ordered(found, [F.col("group_id"), F.col("item_id")]).position("__p").done()
        first = placed.groupBy("group_id").agg(F.min("__p").alias("__f"))
        placed = placed.join(first, "group_id").withColumn("group_index", (F.col("__p") - F.col("__f")).cast("int")).drop("__p", "__f")
        return documents.join(placed.withColumn("group_size", F.col("group_size").cast("int")), "item_id")

    # ------------------------------------------------------------------------------------------ judgements

    def _key(self, prompt: Column) -> Column:
        """What a reply is kept by: the judge, the profile's version and the prompt, which holds the content."""
        return F.sha2(F.concat_ws("_", F.lit(self.judge.name), F.lit(str(self.profile.get("version", 1))), prompt), 256)

    def prompts(self, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(singles, chunks): item_id, prompt, key for what is judged alone; group_id, media_type, chunk, members, prompt,
        key for the chunks of groups."""
        text = F.col("text") if "text" in grouped.columns else None
        judged = grouped if self.config.routing.classify_videos else grouped.where("media_type <> 'video'")
        alone, several = judged.where("group_size = 1"), judged.where("group_size > 1")
        prompt = F.lit(None).cast("string")
        for kind in KINDS:
            prompt = F.when(F.col("media_type") == kind, prompts.item_prompt(self.profile, kind, F.col("path"), text)).otherwise(prompt)
        singles = alone.select("item_id", prompt.alias("prompt")).withColumn("key", self._key(F.col("prompt")))
        size = self.config.bursts.chunk
        line = F.concat((F.col("group_index") % size + 1).cast("string"), F.lit(". "), F.col("path"))
        if text is not None:
            line = F.concat(line, F.coalesce(F.concat(F.lit("\n"), F.substring(text, 1, prompts.GROUP_CHARS)), F.lit("")))
        rows = several.select("group_id", "media_type", "group_index", line.alias("line"))
        chunks = judging.group_prompts(rows, ["group_id", "media_type"], "group_index", "line", size)
        whole = F.lit(None).cast("string")
        for kind in KINDS:
            asked = prompts.group_prompt(self.profile, kind, F.col("members"), F.col("prompt"))
            whole = F.when(F.col("media_type") == kind, asked).otherwise(whole)
        chunks = chunks.withColumn("prompt", whole).withColumn("key", self._key(F.col("prompt")))
        return singles, chunks

    def ask(self, grouped: DataFrame, cache: DataFrame | None = None) -> DataFrame:
        """Items with their own part of a reply (``answer``), the error of a reply that has none, retry_count and cached.
        Equal prompts are asked once; ``cache`` (key, reply) answers what it holds. Replies are written down before they are
        joined, so nothing is asked again when the result is read again."""
        scratch = Scratch(grouped.sparkSession)
        grouped = scratch.keep(grouped)
        singles, chunks = self.prompts(grouped)
        asked = singles.select("key", "prompt").unionByName(chunks.select("key", "prompt")).dropDuplicates(["key"])
        workers = self.config.routing.workers
        if cache is None:
            replies = judging.judged(asked, "key", "prompt", self.judge, self._retry, workers).withColumn("cached", F.lit(False))
        else:
            replies = judging.with_cache(asked, cache, "key", "prompt", self.judge, self._retry, workers)
        replies = scratch.keep(replies)
        one = singles.join(replies, "key").select(
            "item_id", validate.reply_object(F.col("reply")).alias("answer"), "reply", "error_type", "error_message", "retry_count", "cached"
        )
        said = chunks.join(replies, "key").withColumn("answers", validate.reply_list(F.col("reply")))
        said = said.withColumn("answers", F.when(validate.response_shape(F.col("answers"), F.col("members")), F.col("answers")))
        place = {"chunk": F.floor(F.col("group_index") / self.config.bursts.chunk).cast("int")}
        members = grouped.where("group_size > 1").withColumns(place).withColumn("place", (F.col("group_index") % self.config.bursts.chunk).cast("int"))
        answers = judging.spread(members.select("item_id", "group_id", "media_type", "chunk", "place"), said, ["group_id", "media_type", "chunk"], "place", "answers", "answer")
        about = said.select("group_id", "media_type", "chunk", "reply", "error_type", "error_message", "retry_count", "cached")
        many = answers.join(about, ["group_id", "media_type", "chunk"]).select(*one.columns)
        out = grouped.join(one.unionByName(many), "item_id", "left")
        return out.withColumn("judged", F.col("retry_count").isNotNull())

    def read(self, replied: DataFrame) -> DataFrame:
        """Answers turned into checked categories, scores, flags, ranks over the whole group and the extras of their kind;
        failures and unreadable replies become fallbacks."""
        size = self.config.bursts.chunk
        a = F.col("answer")
        rows = replied.withColumns({
            "classification": F.coalesce(a["classification"], F.lit(self.profile["default_category"])), "score": a["score"],
            "local_rank": validate.whole_number(a["rank"]), "reasoning": F.coalesce(a["reasoning"], F.lit("No reasoning provided")),
            "contains_children": a["contains_children"], "is_appropriate": a["is_appropriate"],
            "error_type": F.when(F.col("judged"), F.coalesce("error_type", F.when(a.isNull(), "invalid_response"))),
            "is_error_fallback": F.col("judged") & a.isNull(),
        })
        summary, sound = F.col("media_type").isin("audio", "document"), F.col("media_type").isin("video", "audio")
        rows = rows.withColumns({
            "content_summary": F.when(summary, F.coalesce(a["content_summary"], F.lit(""))),
            "audio_quality": F.when(sound, F.coalesce(a["audio_quality"], F.lit("unknown"))),
        })
        rows = validate.judgement(rows, "classification", "score", self._names, self.profile["default_category"])
        lost = F.col("is_error_fallback")
        note = F.concat(F.lit("Fallback response: "), F.coalesce("error_message", F.col("error_type")))
        rows = rows.withColumn("reasoning", F.when(lost, note).otherwise(F.col("reasoning")))
        ranked = F.coalesce(F.col("local_rank"), F.col("group_index") % size + 1) + F.floor(F.col("group_index") / size).cast("int") * size
        return rows.withColumn("rank", F.when(F.col("group_size") > 1, ranked.cast("int"))).drop("answer", "local_rank")

    def place(self, read: DataFrame) -> DataFrame:
        c = self.config.routing
        category, score = F.col("classification"), F.col("score")
        single = route.single(category, score, F.col("contains_children"), F.col("is_appropriate"), c.share_threshold, c.review_threshold)
        limits = self.profile.get("thresholds") or {}
        own = route.by_threshold(category, score, limits, self._names, self.profile["default_category"])
        out = read.withColumn("destination", F.when(F.col("media_type").isin(*BY_THRESHOLD), own).otherwise(single))
        if c.ranked_bursts:
            burst = (F.col("group_size") > 1) & (F.col("media_type") == "image")
            ranked = route.burst(
                out.where(burst).drop("destination"), "group_id", "group_index", "classification", "score", "rank", "contains_children", "is_appropriate",
                c.share_threshold, c.review_threshold, c.burst_rank_consider, "embedding" if c.diversity and "embedding" in read.columns else None, c.too_similar,
            )
            out = out.where(~burst).unionByName(ranked)
        return out.withColumn("destination", F.when(F.col("judged"), F.col("destination")).otherwise("Videos")).drop("judged")

    def run(self, items: DataFrame, cache: DataFrame | None = None) -> DataFrame:
        return items.transform(self.group).transform(lambda d: self.ask(d, cache)).transform(self.read).transform(self.place)

    def again(self, items: DataFrame, results: DataFrame) -> DataFrame:
        """Failed results judged once more, past any cache: a group whose members all failed as a whole, of other groups the
        failed members alone. items as for ``run``; results: item_id, group_id, group_index, group_size and
        is_error_fallback of an earlier run. ``recover.summary`` compares both."""
        error = F.coalesce("is_error_fallback", F.lit(False))
        rows = results.select("item_id", "group_id", "group_index", "group_size", error.alias("__e"))
        lost = rows.groupBy("group_id").agg(F.bool_and("__e").alias("__whole"))
        bad = rows.where("__e").join(lost, "group_id")
        keep = lambda name, alone: F.when(F.col("__whole"), F.col(name)).otherwise(alone).alias(name)
        bad = bad.select("item_id", keep("group_id", F.col("item_id")), keep("group_index", F.lit(0)), keep("group_size", F.lit(1)))
        return items.join(bad, "item_id").transform(self.ask).transform(self.read).transform(self.place)

    def bundles(self, files: DataFrame) -> DataFrame:
        """(bundle, files, classification, score, is_error_fallback, error_type, destination): each bundle judged as one
        whole. files: bundle, path."""
        asked = judging.bundle_prompts(files, "bundle", "path", "path")
        asked = asked.withColumn("prompt", F.concat(F.lit(prompts.head(self.profile, "bundle") + "\n\n"), "prompt"))
        asked = asked.withColumn("key", self._key(F.col("prompt")))
        replies = judging.judged(asked, "bundle", "prompt", self.judge, self._retry, self.config.routing.workers)
        rows = asked.select("bundle", "files").join(Scratch(files.sparkSession).keep(replies), "bundle")
        rows = rows.withColumn("answer", validate.reply_object(F.col("reply")))
        rows = rows.withColumns({
            "classification": F.coalesce("answer.classification", F.lit(self.profile["default_category"])), "score": F.col("answer.score"),
            "is_error_fallback": F.col("answer").isNull(), "error_type": F.coalesce("error_type", F.when(F.col("answer").isNull(), "invalid_response")),
        })
        rows = validate.judgement(rows, "classification", "score", self._names, self.profile["default_category"])
        own = route.by_threshold(F.col("classification"), F.col("score"), self.profile.get("thresholds") or {}, self._names, self.profile["default_category"])
        return rows.select("bundle", "files", "classification", "score", "is_error_fallback", "error_type", own.alias("destination"))

    def report(self, results: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(counts per destination, five best)."""
        top = stats.top_scored(results, "score", "item_id", "is_error_fallback")
        return stats.counts(results, "destination"), top.select("path", "score", stats.shortened(F.col("reasoning")).alias("reason"))
