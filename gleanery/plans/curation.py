"""More queries of the core operators: sinks and readers as round trips, repair, prompts, the training loop, recovery and
the judging of whole collections; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import media, prompts
from gleanery.operators import grouping, judge, labels, recover, route, stats, validate
from gleanery.plans.pipeline import SIMPLE, Pipeline
from gleanery.plans.queries import (
    _BURSTS, _FILES, _JUDGED, _LATEST, _MOVES, _TIMED, _VOTES, VALID, _document_sessions, _labelled, comparisons, items, judged,
    judgements, moved_items, query, table, timed,
)
from gleanery.scratch import shared_folder
from gleanery.sources import inventory, profiles, sinks


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/gleanery-{uuid.uuid4().hex}/{name}"


# ------------------------------------------------------------------------------------------ round trips

_REPORT = """path as source, destination, classification, score, burst_id, burst_size, burst_index, local_rank as rank, nullif(reasoning, '') as reasoning,
  contains_children, is_appropriate, is_error_fallback, error_type, retry_count"""


def _results(spark, sf_dir) -> DataFrame:
    names = ("path", "destination", "classification", "score", "burst_id", "burst_size", "burst_index", "local_rank", "reasoning",
             "contains_children", "is_appropriate", "is_error_fallback", "error_type", "retry_count")
    return judgements(spark, sf_dir, *names).withColumnsRenamed({"path": "source", "local_rank": "rank"})


@query(f"with {_LATEST} select {_REPORT} from latest_results")
def report_round_trip(spark, sf_dir):
    """The 17-column report, written, found as the newest of its folder and read again."""
    place = _place(spark, "reports")
    profiles.write_report(_results(spark, sf_dir).limit(0), f"{place}/classification_report_1.csv")
    profiles.write_report(_results(spark, sf_dir), f"{place}/classification_report_2.csv")
    return profiles.report(spark, profiles.newest_report(spark, place)).drop("error_message", "content_summary", "key_topics")


@query(
    f"""with {_LATEST} select path, destination, classification, cast(score as varchar) as score, nullif(reasoning, '') as reasoning from latest_results"""
)
def short_report_round_trip(spark, sf_dir):
    place = _place(spark, "short.csv")
    sinks.write_short_report(_results(spark, sf_dir).withColumnRenamed("source", "path"), place)
    return spark.read.options(**sinks.CSV).option("multiLine", True).csv(place)


@query(
    f"""with {_LATEST} select path as source, classification, cast(score as varchar) as score, nullif(reasoning, '') as reasoning, error_type, cast(retry_count as varchar) as retry_count, burst_id
from latest_results where is_error_fallback"""
)
def reprocessing_report_round_trip(spark, sf_dir):
    place = _place(spark, "again.csv")
    sinks.write_reprocessing_report(_results(spark, sf_dir).where("is_error_fallback"), place)
    rows = spark.read.options(**sinks.CSV).option("multiLine", True).csv(place)
    return rows.select("source", "classification", "score", "reasoning", "error_type", "retry_count", "burst_id")


@query(
    """select config_id, profile_name, cast(share_threshold as varchar) as share_threshold, cast(enable_diversity_check as varchar) as enable_diversity_check,
  '{"low":' || review_threshold || ',"high":' || share_threshold || '}' as limits, 'Share,Storage' as names from classification_configs"""
)
def export_round_trip(spark, sf_dir):
    """An export of all columns there are, lists and structs among them."""
    rows = table(spark, sf_dir, "classification_configs").select(
        "config_id", "profile_name", "share_threshold", "enable_diversity_check",
        F.struct(F.col("review_threshold").alias("low"), F.col("share_threshold").alias("high")).alias("limits"),
        F.array(F.lit("Share"), F.lit("Storage")).alias("names"),
    )
    sinks.write_export(rows, place := _place(spark, "export.csv"))
    return spark.read.options(**sinks.CSV).csv(place).withColumn("config_id", F.col("config_id").cast("int"))


@query(f"with {_LATEST} select coalesce(destination, '(none)') as destination, count(*) as n, count(distinct path) as files from latest_results group by 1")
def routed_round_trip(spark, sf_dir):
    """Results in a folder per destination, counted by the folders."""
    profiles.write_routed(_results(spark, sf_dir), place := _place(spark, "routed"))
    rows = spark.read.parquet(place)
    return rows.groupBy(F.coalesce("destination", F.lit("(none)")).alias("destination")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("files")
    )


_PROFILE_ROWS = """p as (select profile_name as name, config_id, ['Share', 'Storage', 'Review', 'Ignore'] as categories, share_threshold, review_threshold from classification_configs)"""


def _profiles(spark, sf_dir) -> DataFrame:
    """The configs as profiles, in the shape of profile files."""
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("color")) for n in VALID])
    return table(spark, sf_dir, "classification_configs").select(
        F.col("profile_name").alias("name"), names.alias("categories"), F.lit("Review").alias("default_category"),
        F.create_map(F.lit("Share"), F.col("share_threshold"), F.lit("Review"), F.col("review_threshold")).alias("thresholds"),
        F.col("config_id").alias("version"),
    )


@query(
    f"""with {_PROFILE_ROWS} select name, max_by(categories, config_id) as categories, 'Review' as default_category,
  name || ': Share, Storage, Review, Ignore; else Review; Review from ' || max_by(review_threshold, config_id) || ', Share from ' || max_by(share_threshold, config_id) as described
from p group by name"""
)
def profile_round_trip(spark, sf_dir):
    """Profile files of two folders, one of them broken: read, appended as versions, the current ones described."""
    place = _place(spark, "profiles")
    one = _profiles(spark, sf_dir).agg(F.to_json(F.collect_list(F.struct("*"))).alias("text"))  # twelve profiles, one file
    one.write.mode("append").text(place)
    spark.createDataFrame([("{broken",)], "text string").write.mode("append").text(place)
    read = profiles.profiles(spark, place)
    sinks.append_version(read, versions := _place(spark, "versions"))
    sinks.append_version(read.withColumns({"version": F.col("version") - 100, "default_category": F.lit("Ignore")}), versions)
    return profiles.listed(profiles.current(spark.read.parquet(versions)))


@query(
    """with s as (select session_id, unnest(max_by(struct_pack(status, total_files, n := len(bursts), m := len(singletons)), updated_at)) from training_sessions group by session_id)
select session_id, status, total_files, n as bursts, m as singletons from s"""
)
def session_round_trip(spark, sf_dir):
    """Saves of training sessions, appended in two goes, read again and cut to the last save of each."""
    rows = table(spark, sf_dir, "training_sessions")
    place, half = _place(spark, "sessions"), F.pmod(F.xxhash64("session_id", "updated_at"), F.lit(2))
    for k in (0, 1):
        sinks.append_sessions(rows.where(half == k), place)
    last = profiles.latest_sessions(profiles.sessions(spark, place, lines=True))
    return last.select("session_id", "status", "total_files", F.size("bursts").cast("long").alias("bursts"), F.size("singletons").cast("long").alias("singletons"))


@query(f"with {_LATEST} select path as file_path, trim(classification) as correct_category, reasoning, judged_at as submitted_at from latest_results where path is not null")
def feedback_round_trip(spark, sf_dir):
    rows = judgements(spark, sf_dir, "path", "classification", "reasoning", "judged_at").where("path is not null")
    rows = rows.select(F.col("path").alias("file_path"), F.trim("classification").alias("correct_category"), "reasoning", F.col("judged_at").alias("submitted_at"))
    place, half = _place(spark, "feedback"), F.pmod(F.xxhash64("file_path"), F.lit(2))
    for k in (0, 1):
        sinks.append_feedback(rows.where(half == k), place)
    return profiles.feedback(spark, place, lines=True)


@query(
    f"""with {_LATEST}, e as (select result_id as key, case when error_type is null then reasoning end as reply, error_type, loaded_at from latest_results)
select key, reply, reply is not null and epoch_us(timestamptz '2025-03-01 00:00:00+00') - epoch_us(loaded_at) <= 300 * 86400000000 as answers from e
where reply is not null"""
)
def cache_round_trip(spark, sf_dir):
    """Replies written to the cache without the failures; which may still answer 300 days on."""
    rows = judgements(spark, sf_dir, "reasoning", "error_type").select(
        F.lit("replies").alias("store"), F.col("result_id").alias("key"), F.when(F.col("error_type").isNull(), F.col("reasoning")).alias("reply"),
        F.length("reasoning").cast("long").alias("size_bytes"), F.col("loaded_at").alias("created_at"), "error_type",
    )
    place = _place(spark, "cache")
    sinks.append_cache(rows, place)
    sinks.append_cache(rows.withColumns({"reply": F.lit("older"), "created_at": F.col("created_at") - F.expr("interval 1 day")}), place)
    kept = sinks.newest_entries(spark.read.parquet(place))
    good = recover.usable_entries(kept, F.lit("2025-03-01 00:00:00").cast("timestamp"), 300).select("key", F.lit(True).alias("answers"))
    return kept.where("reply <> 'older'").join(good, "key", "left").select("key", "reply", F.coalesce("answers", F.lit(False)).alias("answers"))


# ------------------------------------------------------------------------------------------ features and types


@query(
    f"""with {_FILES} select item_id, coalesce(ext in ({', '.join(repr(e) for e in inventory.CODE)}), false) as code, coalesce(kind in ('image', 'video', 'audio'), false) as media
from files"""
)
def file_kinds(spark, sf_dir):
    path = F.col("path")
    return items(spark, sf_dir).select("item_id", inventory.is_code(path).alias("code"), inventory.is_media(path).alias("media"))


_BOXES = """b as (select item_id, list_transform(range(1, cast(size_bytes % 5 as int) + 1), lambda k: {'w': cast(size_bytes % 97 + 5 * k as int),
    'h': cast(size_bytes % 61 + 3 * k as int), 'eyes': cast((size_bytes + k) % 4 as int), 'smiles': cast((size_bytes // 7 + k) % 3 as int)}) as boxes
  from media_items where size_bytes is not null),
f as (select item_id, boxes, len(boxes) as n, coalesce(list_sum(list_transform(boxes, lambda x: x.w * x.h)), 0)::double as total,
  coalesce(list_max(list_transform(boxes, lambda x: x.w * x.h)), 0)::double as largest from b)"""


@query(
    f"""with {_BOXES} select item_id, cast(least(n, 3) as int) as num_faces, round(total / 120000, 9) as face_ratio, round(largest / 120000, 9) as largest_face_ratio,
  cast(n > 0 as int) as has_face, round(case when n > 0 then total / n / 120000 else 0 end, 9) as avg_face_size,
  cast(len(list_filter(boxes, lambda x: x.eyes >= 2)) as int) as eyes_detected, cast(len(list_filter(boxes, lambda x: x.smiles > 0)) as int) as smile_detected from f"""
)
def face_measures(spark, sf_dir):
    """Measures over boxes of faces; boxes derived from sizes stand in for detection."""
    s = F.col("size_bytes")
    box = lambda k: F.struct(
        (s % 97 + 5 * k).cast("int").alias("w"), (s % 61 + 3 * k).cast("int").alias("h"),
        ((s + k) % 4).cast("int").alias("eyes"), ((F.floor(s / 7) + k) % 3).cast("int").alias("smiles"),
    )
    some = F.transform(F.sequence(F.lit(1), (s % 5).cast("int")), box)
    boxes = F.when(s % 5 > 0, some)
    rows = table(spark, sf_dir, "media_items").where("size_bytes is not null").select("item_id", media.faces(boxes, F.lit(400), F.lit(300), 3).alias("f")).select("item_id", "f.*")
    return rows.withColumns({c: F.round(c, 9) for c in ("face_ratio", "largest_face_ratio", "avg_face_size")})


# ------------------------------------------------------------------------------------------ repair


@query(
    """select p_partkey, case when p_size is null then null else greatest(1, least(5, p_size % 9)) end as sharp, cast(null as int) as light,
  case when p_partkey % 2 = 0 then 1 else greatest(1, least(5, cast(floor(p_retailprice / 300) as int))) end as mood from part"""
)
def dimension_scores(spark, sf_dir):
    """Dimension scores of replies: numbers are cut and clamped, booleans are 0 or 1, strings and what is missing are null."""
    price = (F.floor(F.col("p_retailprice") / 300).cast("int") + F.lit(0.75)).cast("string")
    mood = F.when(F.col("p_partkey") % 2 == 0, "true").otherwise(price)
    size = F.coalesce((F.col("p_size") % 9).cast("string"), F.lit("null"))
    text = F.concat(F.lit('{"sharp": '), size, F.lit(', "light": "4", "odd": 3, "mood": '), mood, F.lit("}"))
    scores = validate.dimensions(F.parse_json(text), ["sharp", "light", "mood"])
    return table(spark, sf_dir, "part").select("p_partkey", *[scores[n].alias(n) for n in ("sharp", "light", "mood")])


@query(
    f"""with {_LATEST} select result_id, coalesce(is_error_fallback, coalesce(contains(reasoning, 'Fallback response:'), false)) as error,
  coalesce(contains(reasoning, 'Fallback response:'), false) as legacy,
  case when coalesce(error_type = 'load_error', false) or coalesce(retry_count = 3, false) then 'safety_blocked'
    when trim(coalesce(reasoning, '')) = '' then 'invalid_response' end as kind from latest_results"""
)
def reply_errors(spark, sf_dir):
    """Errors by the flag or, in reports without one, by the reasoning; errors of raw replies by what blocked them."""
    rows = judgements(spark, sf_dir, "is_error_fallback", "reasoning", "error_type", "retry_count")
    said = F.col("reasoning")
    return rows.select(
        "result_id", recover.is_error(F.col("is_error_fallback"), said).alias("error"), recover.is_error(None, said).alias("legacy"),
        validate.response_error(F.col("error_type") == "load_error", F.col("retry_count"), said).alias("kind"),
    )


@query(
    f"""with {_FILES}, r as (select item_id, kind, case when item_id % 2 = 0 then 'clear' end as q, case when item_id % 3 = 0 then 'seen' end as s from files)
select item_id, kind, case when kind in ('video', 'audio') then coalesce(q, 'unknown') end as audio_quality,
  case when kind in ('audio', 'document') then coalesce(s, '') end as content_summary, case when kind = 'document' then 0 end as topics from r
where kind in ('video', 'audio', 'document')"""
)
def extra_fields(spark, sf_dir):
    """The extra fields of judgements of videos, audio and documents, filled where they are missing."""
    rows = items(spark, sf_dir).select("item_id", F.col("media_type").alias("kind"))
    quality, summary = F.when(F.col("item_id") % 2 == 0, "clear").alias("audio_quality"), F.when(F.col("item_id") % 3 == 0, "seen").alias("content_summary")
    none = F.lit(None).cast("string")
    video = validate.with_extras(rows.where("kind = 'video'").select("*", quality), "video").withColumns({"content_summary": none, "topics": F.lit(None).cast("int")})
    audio = validate.with_extras(rows.where("kind = 'audio'").select("*", quality, summary), "audio").withColumn("topics", F.lit(None).cast("int"))
    document = validate.with_extras(rows.where("kind = 'document'").select("*", summary), "document")
    document = document.withColumns({"audio_quality": none, "topics": F.size("key_topics")}).drop("key_topics")
    return video.unionByName(audio).unionByName(document)


@query(
    f"""with {_LATEST} select result_id, 'Review' as classification, 2 as score, 'Fallback response: ' || coalesce(reasoning, 'no detail') as reasoning,
  true as is_error_fallback, coalesce(error_type, 'api_error') as error_type, 2 as dimensions from latest_results where is_error_fallback"""
)
def fallback_rows(spark, sf_dir):
    rows = recover.judged_in_error(judgements(spark, sf_dir, "reasoning", "error_type", "is_error_fallback"))
    out = validate.fallback(rows.withColumnRenamed("reasoning", "said"), "Review", F.col("error_type"), F.col("said"), expected=["sharp", "light"])
    return out.select("result_id", "classification", "score", "reasoning", "is_error_fallback", "error_type", F.size("dimensions").alias("dimensions"))


# ------------------------------------------------------------------------------------------ counts


@query(f"with {_LATEST} select coalesce(destination, '(none)') as destination, count(*) as n from latest_results group by 1")
def merged_counts(spark, sf_dir):
    """Counts of one part of the configs and of the others, merged: those of all."""
    rows = judgements(spark, sf_dir, "destination", "config_id")
    part = F.coalesce(F.col("config_id") <= 6, F.lit(False))
    return stats.merge_counts(*[stats.counts(rows.where(p), "destination", "(none)") for p in (part, ~part)], by="destination")


@query(f"{_VOTES} select round(coalesce(avg(case when side = 'share' then 1.0 else 0.0 end), 0.275), 9) as ratio from labelled")
def share_ratio(spark, sf_dir):
    return spark.createDataFrame([(round(labels.share_ratio(_labelled(spark, sf_dir)), 9),)], "ratio double")


@query(
    f"""with {_FILES}, n as (select count(*) filter (kind = 'image') as i, count(*) filter (kind = 'video') as v, count(*) filter (kind = 'audio') as a,
  count(*) filter (kind = 'document') as d from files)
select i > 0 as image, v > 0 as video, a > 0 as audio, d > 0 as document, case when cast(i + v > 0 as int) + cast(a > 0 as int) + cast(d > 0 as int) > 1 then 'mixed'
  when d > 0 then 'document' when a > 0 then 'audio' when v > 0 and i = 0 then 'video' else 'image' end as kind from n"""
)
def collection_kinds(spark, sf_dir):
    return inventory.kinds(items(spark, sf_dir))


@query(
    """with t as (select item_id, size_bytes, modified_at, epoch_us(timestamptz '2025-01-01 00:00:00+00') - epoch_us(modified_at) > 200 * 86400000000 as late
  from media_items where modified_at is not null),
s as (select cast(sum(size_bytes) as bigint) as total from t where not late),
r as (select *, sum(size_bytes) over (order by modified_at, item_id rows unbounded preceding) - coalesce(size_bytes, 0) as before from t where not late)
select item_id, case when (select total from s) - before > (select total // 2 from s) * 0.9 then 'evicted' else 'kept' end as fate from r
union all select item_id, 'expired' from t where late"""
)
def cache_cleanup(spark, sf_dir):
    """Expired entries go first, then the oldest of the rest until nine tenths of half their bytes are left."""
    rows = table(spark, sf_dir, "media_items").where("modified_at is not null").select("item_id", "size_bytes", "modified_at")
    late = media.expired(F.col("modified_at"), F.lit("2025-01-01 00:00:00").cast("timestamp"), 200)
    total = rows.where(~late).agg(F.sum("size_bytes")).first()[0] or 0
    return stats.cleanup(rows, "size_bytes", "modified_at", "item_id", late, total // 2).select("item_id", "fate")


# ------------------------------------------------------------------------------------------ training


def _session_bursts(spark, sf_dir) -> DataFrame:
    """(session_id, burst_no, position, item) of the last save of every session."""
    last = table(spark, sf_dir, "training_sessions").groupBy("session_id").agg(F.max_by("bursts", "updated_at").alias("bursts"))
    rows = last.select("session_id", F.posexplode("bursts").alias("burst_no", "files"))
    return rows.select("session_id", "burst_no", F.posexplode("files").alias("position", "item"))


def _labelled_items(spark, sf_dir) -> DataFrame:
    done = comparisons(spark, sf_dir).where("choice is not null")
    return done.select("session_id", F.explode(F.array("photo_a", "photo_b")).alias("item")).distinct()


@query(
    f"""{_BURSTS}, c as (select session_id, cast(burst_no as int) as burst_no, count(*) as unlabelled from free group by all having count(*) >= 2),
r as (select *, cast(row_number() over (partition by session_id order by unlabelled desc, burst_no) as int) as place, count(*) over (partition by session_id) as n from c)
select session_id, burst_no, unlabelled, place from r where place <= greatest(3, n // 3)"""
)
def pair_sources(spark, sf_dir):
    bursts = _session_bursts(spark, sf_dir).select("session_id", "burst_no", "item")
    return labels.pair_sources(labels.burst_candidates(bursts, _labelled_items(spark, sf_dir)))


@query(
    f"""{_BURSTS}, k as (select session_id, burst_no, count(distinct item) as items from m group by all having count(distinct item) >= 5),
c as (select session_id, burst_no, count(*) as unlabelled from free group by all having count(*) >= 3),
r as (select *, row_number() over (partition by session_id order by unlabelled desc, burst_no) as place, count(*) over (partition by session_id) as n from c join k using (session_id, burst_no)),
g as (select session_id, burst_no from r where place <= greatest(2, n // 2)),
p as (select session_id, b.no as burst_no, unnest(b.files) as item, cast(generate_subscripts(b.files, 1) - 1 as int) as position from (
  select session_id, unnest(list_transform(bursts, lambda x, i: struct_pack(no := i - 1, files := x))) as b from s))
select session_id, cast(burst_no as int) as burst_no, position, item from p join g using (session_id, burst_no) where position < 20"""
)
def gallery_items(spark, sf_dir):
    """The galleries that may be shown, with their first twenty items."""
    placed = _session_bursts(spark, sf_dir)
    sources = labels.gallery_sources(placed.select("session_id", "burst_no", "item"), _labelled_items(spark, sf_dir))
    return labels.gallery_items(sources, placed)


@query(f"{_BURSTS} select session_id, cast(burst_no as int) as burst_no, min_by(item, md5(item)) as item from m group by all")
def burst_representatives(spark, sf_dir):
    return labels.representatives(_session_bursts(spark, sf_dir).select("session_id", "burst_no", "item"))


@query(
    """with s as (select session_id, max_by(singletons, updated_at) as photos from training_sessions group by session_id),
v as (select unnest(photos) as item, generate_subscripts(photos, 1) - 1 as k from s),
b as (select item, max(case when k % 3 = 0 then 0.95 end) as s, max(case when k % 3 > 0 then 0.85 end) as t from v where item is not null group by item)
select item, case when s is not null then 'share' else 'storage' end as side, cast(coalesce(s, t) as double) as confidence from b"""
)
def gallery_labels(spark, sf_dir):
    """Labels from galleries: every third photo of a session's single ones taken as selected."""
    last = table(spark, sf_dir, "training_sessions").groupBy("session_id").agg(F.max_by("singletons", "updated_at").alias("photos"))
    picked = F.filter(F.sequence(F.lit(0), F.greatest(F.size("photos"), F.lit(1)) - 1), lambda k: k % 3 == 0)
    return labels.gallery_labels(last.withColumn("picked", picked), "photos", "picked")


@query(
    f"""{_VOTES}, e as (select item, side, row_number() over (partition by side order by item) as place from labelled where item in (select path from media_items))
select item, side, cast(place as int) as place from e where place <= 50"""
)
def profile_samples(spark, sf_dir):
    """The examples of each side that a profile is made from: the first fifty that are still there."""
    there = table(spark, sf_dir, "media_items").select(F.col("path").alias("item"))
    return labels.samples(_labelled(spark, sf_dir), "side", F.col("item"), there, "item").select("item", "side", "place")


@query(
    """with p as (select pair_id, max_by(comparison_type, loaded_at) as kind from pairwise_comparisons group by pair_id)
select pair_id, case kind when 'within_burst' then 2.0::double when 'gallery' then 1.5::double else 1.0::double end as weight from p"""
)
def recorded_comparisons(spark, sf_dir):
    """Answers as they are recorded, appended to a table and read again."""
    rows = labels.recorded(comparisons(spark, sf_dir).select("pair_id", "comparison_type"), "comparison_type")
    rows.write.mode("append").parquet(place := _place(spark, "comparisons"))
    return spark.read.parquet(place).select("pair_id", "weight")


@query(
    f"""{_MOVES} select item_id, cast(item_id as varchar) || ': ' || was || ' -> ' || now || ' (sharp=' || item_id % 5 || ')' as line from f where was <> now"""
)
def correction_lines(spark, sf_dir):
    """Corrections as a refining prompt lists them."""
    dims = F.create_map(F.lit("sharp"), (F.col("item_id") % 5).cast("int"), F.lit("light"), F.lit(None).cast("int"))
    line = prompts.correction_line(F.col("item_id").cast("string"), F.col("was"), F.col("now"), dims)
    return moved_items(spark, sf_dir).select("item_id", line.alias("line"))


_GROUPS = f"""{_TIMED}, kinds as (select item_id, kind from files)"""


@query(
    f"""with recursive {_FILES}, {_TIMED},
u as (select feature_id as id, list_transform(embedding, lambda x: cast(x as double)) as v from document_features
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.id as a, b.id as b from u a join u b on a.id <> b.id where round(list_cosine_similarity(a.v, b.v), 9) >= 0.8 union all select feature_id, feature_id from document_features),
reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
i as (select item_id from files where kind = 'image'),
g as (select t.item_id, t.folder, t.tm, sum(case when epoch_us(tm) - epoch_us(lag_tm) <= 10000000 then 0 else 1 end) over (partition by folder order by tm, item_id rows unbounded preceding) as g
  from (select *, lag(tm) over (partition by folder order by tm, item_id) as lag_tm from timed where tm is not null and item_id in (select item_id from i)) t)
select item_id, first_value(item_id) over (partition by folder, g order by tm, item_id) as group_id, 'image' as kind from g
union all select item_id, item_id, 'image' from timed where tm is null and item_id in (select item_id from i)
union all select item_id, item_id, 'video' from files where kind = 'video'
union all select a + 1000000000, min(b) + 1000000000, 'document' from reach group by a"""
)
def training_groups(spark, sf_dir):
    """Groups of a training session over all media items and document files."""
    rows = timed(spark, sf_dir).join(items(spark, sf_dir).select("item_id", "media_type"), "item_id")
    docs = table(spark, sf_dir, "document_features")
    good = F.when(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.col("embedding"))
    docs = docs.select((F.col("feature_id") + 1_000_000_000).alias("item_id"), good.alias("embedding"))
    return grouping.training_groups(rows.where("media_type = 'image'").drop("media_type"), rows.where("media_type = 'video'"), docs, 64)


# ------------------------------------------------------------------------------------------ recovery


@query(
    f"""with {_LATEST}, f as (select item_id, min_by(struct_pack(d := destination, e := is_error_fallback), struct_pack(judged_at, result_id)) as was,
  max_by(struct_pack(d := destination, e := is_error_fallback), struct_pack(judged_at, result_id)) as now from latest_results where item_id is not null group by item_id),
e as (select * from f where was.e)
select count(*) as rows, count(*) filter (coalesce(now.e, true)) as still_error, count(*) filter (not coalesce(now.e, true) and coalesce(now.d, 'Review') = 'Review') as still_review,
  count(*) filter (not coalesce(now.e, true) and coalesce(now.d, 'Review') <> 'Review') as recovered from e"""
)
def recovery_summary(spark, sf_dir):
    """Items whose first judgement failed, and what their last one says."""
    at = F.struct("judged_at", "result_id")
    rows = judgements(spark, sf_dir, "item_id", "destination", "is_error_fallback", "judged_at").where("item_id is not null")
    one = F.struct("destination", "is_error_fallback")
    both = rows.groupBy("item_id").agg(F.min_by(one, at).alias("was"), F.max_by(one, at).alias("now")).where("was.is_error_fallback")
    return recover.summary(both.select("item_id"), both.select("item_id", "now.*"), "item_id")


@query(
    f"""with {_LATEST}, r as (select result_id, nullif(burst_id, '') as burst_id, coalesce(is_error_fallback, false) as e from latest_results),
c as (select burst_id, count(*) as members from r where burst_id is not null group by burst_id)
select result_id, r.burst_id, coalesce(members, 0) as members from r left join c using (burst_id) where e"""
)
def failed_with_context(spark, sf_dir):
    """Failed judgements with the number of members that their burst's context holds."""
    rows = judgements(spark, sf_dir, "burst_id", "is_error_fallback").withColumn("burst_id", F.nullif(F.col("burst_id"), F.lit("")))
    context = recover.burst_context(rows, "burst_id", "result_id")
    return recover.with_context(rows.where("is_error_fallback"), context, "burst_id").select("result_id", "burst_id", "members")


@query(
    f"""with {_LATEST}, d as (select item_id, max_by(destination, struct_pack(judged_at, result_id)) as d from latest_results group by item_id)
select path, case when d = 'Review' then '/review' || path when i.item_id % 7 <> 0 then path end as place from media_items i left join d using (item_id)
where d = 'Review' or i.item_id % 7 <> 0"""
)
def current_places(spark, sf_dir):
    """Where items are now: a copy in review, else the source if it is still there (here: all but every seventh)."""
    at = F.struct("judged_at", "result_id")
    last = judgements(spark, sf_dir, "item_id", "destination", "judged_at").groupBy("item_id").agg(F.max_by("destination", at).alias("d"))
    files = table(spark, sf_dir, "media_items").select("item_id", "path")
    copies = files.join(last.where("d = 'Review'"), "item_id").select("path", F.concat(F.lit("/review"), "path").alias("copy"))
    return recover.current_place(files.select("path"), copies, files.where("item_id % 7 <> 0").select("path"), "path")


# ------------------------------------------------------------------------------------------ judging


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The deterministic judge in SQL: byte k (from 0) of a prompt's SHA-256.
_BYTE = "cast(('0x' || substr(sha256({0}), {1}, 2)) as int)"


def _category(prompt: str) -> str:
    return f"['Share', 'Storage', 'Review', 'Ignore'][{_BYTE.format(prompt, 1)} % 4 + 1]"


def _score(prompt: str) -> str:
    return f"{_BYTE.format(prompt, 3)} % 5 + 1"


def _single_heads(kinds) -> str:
    return "case kind " + " ".join(f"when '{k}' then {_literal(prompts.head(SIMPLE, k))}" for k in kinds) + " end"


_GROUP_HEAD = prompts.head(SIMPLE, "image", -1).split("-1")
_GROUP_PROMPT = f"{_literal(_GROUP_HEAD[0])} || n || {_literal(_GROUP_HEAD[1])} || n || {_literal(_GROUP_HEAD[2])} || chr(10) || chr(10) || lines"


@query(
    f"""with {_FILES}, {_TIMED.replace("from media_items)", "from media_items where item_id in (select item_id from files where kind = 'image'))")},
image as (select item_id, group_id, group_index, group_size from grouped
  union all select item_id, item_id, 0, 1 from timed where tm is null),
every as (select f.item_id, f.path, f.kind, coalesce(i.group_id, f.item_id) as group_id, coalesce(i.group_index, 0) as group_index, coalesce(i.group_size, 1) as group_size
  from files f left join image i using (item_id) where f.kind is not null),
one as (select item_id, {_single_heads(('image', 'video', 'audio', 'document'))} || chr(10) || chr(10) || 'Item: ' || path as prompt from every where group_size = 1),
chunks as (select group_id, group_index // 10 as chunk, count(*) as n, string_agg(group_index % 10 + 1 || '. ' || path, chr(10) order by group_index) as lines
  from every where group_size > 1 group by 1, 2),
asked as (select group_id, chunk, {_GROUP_PROMPT} as prompt from chunks),
many as (select item_id, prompt || '#' || (group_index % 10 + 1) as prompt from every e join asked a on a.group_id = e.group_id and a.chunk = e.group_index // 10 where group_size > 1),
replies as (select * from one union all select * from many),
j as (select e.*, {_category('r.prompt')} as category, {_score('r.prompt')} as points from every e join replies r using (item_id))
select item_id, kind as media_type, group_id, group_index, group_size, category as classification, cast(points as int) as score, false as is_error_fallback,
  case when group_size > 1 then group_index + 1 end as rank,
  case when kind in ('document', 'audio') then case when points < case category when 'Share' then 4 when 'Review' then 3 else 0 end then 'Review' else category end
    when category = 'Ignore' then 'Ignore' when category = 'Review' then 'Review' when category = 'Share' and points >= 4 then 'Share'
    when points >= 3 then 'Review' else 'Storage' end as destination from j"""
)
def classify_collection(spark, sf_dir):
    """The pipeline over all media items with the deterministic judge: bursts by time judged in chunks of ten, the others
    alone, each kind by its prompt and its route."""
    rows = timed(spark, sf_dir).join(items(spark, sf_dir).select("item_id", "path", "media_type"), "item_id")
    return Pipeline().run(rows).select(
        "item_id", "media_type", "group_id", "group_index", "group_size", "classification", "score", "is_error_fallback", "rank", "destination"
    )


@query(
    f"""with {_FILES}, b as (select regexp_extract(folder, '[^/]*$') as bundle, path from files where kind is not null and regexp_replace(folder, '/[^/]*$', '') = '/library'),
g as (select bundle, count(*) as files, {_literal(prompts.head(SIMPLE, 'bundle'))} || chr(10) || chr(10) || string_agg(path, chr(10) order by path) as prompt from b group by bundle),
j as (select bundle, files, {_category('prompt')} as classification, cast({_score('prompt')} as int) as score from g)
select *, false as is_error_fallback, cast(null as varchar) as error_type,
  case when score < case classification when 'Share' then 4 when 'Review' then 3 else 0 end then 'Review' else classification end as destination from j"""
)
def judged_bundles(spark, sf_dir):
    """Every folder of the library judged as one whole."""
    rows = items(spark, sf_dir).where("media_type is not null").where(inventory.folder(F.col("folder")) == "/library")
    return Pipeline().bundles(rows.select(inventory.file_name(F.col("folder")).alias("bundle"), "path"))


_PLAIN = {"name": "plain", "categories": [{"name": n} for n in VALID], "thresholds": {"Share": 4, "Review": 3}}


@query(
    f"""with p as (select doc_id, {_literal(prompts.head(_PLAIN, 'document'))} || case when source is null then '' else chr(10) || chr(10) || 'Item: ' || source end || chr(10) || chr(10)
  || coalesce(case when length(text) > {prompts.SINGLE_CHARS} then text[:{prompts.SINGLE_CHARS}] || chr(10) || '[cut]' else text end, '') as prompt from documents)
select doc_id, {_category('prompt')} as category, cast({_score('prompt')} as int) as score, cast(null as varchar) as error_type, 0 as retry_count from p"""
)
def judged_documents(spark, sf_dir):
    """Documents judged by the deterministic judge behind the same interface as any other, in Arrow batches."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", prompts.item_prompt(_PLAIN, "document", F.col("source"), F.col("text")).alias("prompt")
    )
    replies = judge.judged(docs, "doc_id", "prompt", judge.SteadyJudge())
    j = validate.reply_object(F.col("reply"))
    return replies.select("doc_id", j["classification"].alias("category"), validate.whole_number(j["score"]).alias("score"), "error_type", "retry_count")


_DOCUMENTS = """timed as (select feature_id as item_id, regexp_replace(path, '/[^/]*$', '') as folder, extracted_at as tm, embedding as v from document_features),
gaps as (select *, case when epoch_us(tm) - epoch_us(lag(tm) over w) <= 2592000000000 then 0 else 1 end as s from timed where tm is not null window w as (partition by folder order by tm, item_id)),
numbered as (select *, sum(s) over (partition by folder order by tm, item_id rows unbounded preceding) as gn from gaps),
rows as (select item_id, first_value(item_id) over w as g, row_number() over w as i, count(*) over (partition by folder, gn) as n,
  case when v is not null and len(list_filter(v, lambda x: isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0 then list_transform(v, lambda x: cast(x as double)) end as v
  from numbered window w as (partition by folder, gn order by tm, item_id))"""


@query(
    f"""with recursive {_DOCUMENTS},
links as (select a.g, a.i, b.i as j from rows a join rows b on a.g = b.g and a.i < b.i where a.v is not null and b.v is not null and list_cosine_similarity(a.v, b.v) >= 0.92),
near as (select g, i, list(j order by j) as js from links group by g, i),
adj as (select r.g, any_value(r.n) as n, list(coalesce(near.js, []) order by r.i) as adj from rows r left join near on near.g = r.g and near.i = r.i group by r.g),
step(g, n, adj, pos, cur, gone, made, over) as (
  select g, n, adj, 1::bigint, [1::bigint], [1::bigint], []::bigint[][], false from adj
  union all
  select g, n, adj, coalesce(nxt, seed, pos), case when nxt is not null then cur || [nxt] when seed is not null then [seed] else cur end,
    case when coalesce(nxt, seed) is null then gone else gone || [coalesce(nxt, seed)] end, case when nxt is null then made || [cur] else made end, nxt is null and seed is null
  from (select *, list_min(list_filter(flatten(list_transform(cur, lambda k: adj[k])), lambda j: j > pos and not list_contains(gone, j))) as nxt,
      list_min(list_filter(range(1, n + 1), lambda j: not list_contains(gone, j))) as seed from step where not over) t),
made as (select g, unnest(made) as c from step where over),
placed as (select g, unnest(c) as i, generate_subscripts(c, 1) - 1 as p, len(c) as size, c from made),
cut as (select g, i, p, least(50, size - p // 50 * 50) as size, c[p // 50 * 50 + 1] as head from placed)
select r.item_id, case when size < 2 then r.item_id else h.item_id end as burst_id, cast(case when size < 2 then 0 else p % 50 end as int) as burst_index,
  cast(case when size < 2 then 1 else size end as int) as burst_size
from cut join rows r on r.g = cut.g and r.i = cut.i join rows h on h.g = cut.g and h.i = cut.head"""
)
def burst_clusters(spark, sf_dir):
    """Greedy similarity clusters within the temporal groups of each folder's documents."""
    found = grouping.similar_bursts(_document_sessions(spark, sf_dir), "item_id", "embedding", "at", limit=0.92)
    return found.withColumnRenamed("item", "item_id")


@query(
    f"""with {_DOCUMENTS},
r as (select *, cast(item_id % 3 + 3 as int) as points from rows where n > 1),
high as (select * from r where points >= 4),
links as (select a.g, a.i, list(b.i) as js from high a join high b on a.g = b.g and b.i < a.i where a.v is not null and b.v is not null and list_cosine_similarity(a.v, b.v) >= 0.95 group by a.g, a.i),
ordered as (select h.g, list({{'i': [h.i], 'js': coalesce(l.js, [])}} order by h.i) as all_ from high h left join links l on l.g = h.g and l.i = h.i group by h.g),
taken as (select g, list_reduce(list_prepend({{'i': []::bigint[], 'js': []::bigint[]}}, all_),
  lambda acc, x: {{'i': case when list_has_any(acc.i, x.js) then acc.i else acc.i || x.i end, 'js': []::bigint[]}}).i as i from ordered)
select item_id, r.g as group_id, points, case when points >= 4 and list_contains(t.i, r.i) then 'Share' when points >= 3 then 'Review' else 'Storage' end as destination
from r left join taken t on t.g = r.g"""
)
def route_burst_varied(spark, sf_dir):
    """Bursts of documents by folder and time, where near copies of a shared one are not shared again."""
    docs = _document_sessions(spark, sf_dir).where("group_size > 1")
    score = (F.col("item_id") % 3 + 3).cast("int")
    rows = docs.select(
        "item_id", "group_id", "group_index", F.lit("Share").alias("category"), score.alias("points"), F.lit(1).alias("rank"),
        F.lit(True).alias("children"), F.lit(True).alias("fit"), F.when(media.cosine(F.col("embedding"), F.col("embedding")) > 0, media.normalised(F.col("embedding"))).alias("v"),
    )
    return route.burst(rows, "group_id", "group_index", "category", "points", "rank", "children", "fit", vec="v").select(
        "item_id", "group_id", "points", "destination"
    )


@query(
    """with t as (select doc_id, case when trim(regexp_replace(text, '[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\p{Z}]+', ' ', 'g')) = '' then null else '  ' || lower(text) || '  ' end as t from documents),
c as (select doc_id, list_transform(range(1, length(t) + 1), lambda i: cast(unicode(substr(t, i, 1)) as ubigint)) as c from t where t is not null),
h as (select doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: xor(xor(c[i] * 2654435761, c[i + 1] * 2246822507), c[i + 2] * 3266489909) & 4294967295)) as h from c),
b as (select doc_id, h % 64 as k, sum(case when (h >> 16) & 1 = 1 then 1 else -1 end)::double as v from h group by 1, 2),
n as (select doc_id, sqrt(sum(v * v)) as norm, max(v) as top, count(*) as k from b group by doc_id)
select doc_id, round(cast(cast(case when k < 64 then greatest(top, 0) else top end / norm as float) as double), 3) as largest from documents left join n using (doc_id)"""
)
def embedded_documents(spark, sf_dir):
    """Whole documents with vectors of the default embedder; blank texts have none."""
    from gleanery.functions import embed

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed.with_embedding(docs, "text", embed.HashedTrigrams()).select("doc_id", F.round(F.array_max("embedding").cast("double"), 3).alias("largest"))
