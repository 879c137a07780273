"""The queries of the core operators and the SQL they are checked against, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import html, media, prompts
from gleanery.operators import grouping, labels, recover, route, stats, validate
from gleanery.sources import inventory
from gleanery.streaming import bursts as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VALID = ["Share", "Storage", "Review", "Ignore"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------------------------------ inventory

_TYPES = {
    "image": inventory.IMAGE, "video": inventory.VIDEO, "audio": inventory.AUDIO, "document": inventory.DOCUMENT + inventory.CODE,
}
_EXT = r"lower(regexp_extract(path, '[^/]\.([^./]+)$', 1))"
_KIND = "case " + " ".join(
    f"when {_EXT} in ({', '.join(repr(e) for e in es)}) then '{k}'" for k, es in _TYPES.items()
) + " end"
_FILES = f"""files as (
  select item_id, path, size_bytes, regexp_replace(path, '/[^/]*$', '') as folder, {_EXT} as ext, {_KIND} as kind
  from media_items)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_items with type, extension and folder taken from the path."""
    path = F.col("path")
    return table(spark, sf_dir, "media_items").select(
        "item_id", "path", "file_name", "size_bytes", "captured_at", "modified_at", inventory.extension(path).alias("ext"),
        inventory.media_type(path).alias("media_type"), inventory.folder(path).alias("folder"),
    )


@query(f"with {_FILES} select kind as media_type, ext, count(*) as files from files group by all")
def media_types(spark, sf_dir):
    return items(spark, sf_dir).groupBy("media_type", "ext").agg(F.count(F.lit(1)).alias("files"))


@query(
    f"""with {_FILES} select kind as media_type, count(*) as files, cast(sum(size_bytes) as bigint) as bytes
from files where kind is not null group by kind"""
)
def media_inventory(spark, sf_dir):
    return inventory.inventory(items(spark, sf_dir))


@query(
    f"""with {_FILES},
n as (select folder, count(*) filter (kind = 'image') as i, count(*) filter (kind = 'video') as v,
  count(*) filter (kind = 'audio') as a, count(*) filter (kind = 'document') as d from files group by folder)
select folder, case when cast(i + v > 0 as int) + cast(a > 0 as int) + cast(d > 0 as int) > 1 then 'mixed'
  when d > 0 then 'document' when a > 0 then 'audio' when v > 0 and i = 0 then 'video' else 'image' end as kind from n"""
)
def predominant_types(spark, sf_dir):
    return inventory.predominant_types(items(spark, sf_dir))


@query(
    f"""with {_FILES} select regexp_extract(folder, '[^/]*$') as bundle, count(*) as files,
  list_sort(list(distinct kind)) as types
from files where kind is not null and regexp_replace(folder, '/[^/]*$', '') = '/library' group by folder"""
)
def bundles(spark, sf_dir):
    return inventory.bundles(items(spark, sf_dir), "/library")


@query(
    f"""with {_FILES} select item_id, path, kind as media_type from files where kind is not null
order by list_position(['image', 'video', 'audio', 'document'], kind), path limit 50 offset 100"""
)
def inventory_page(spark, sf_dir):
    return inventory.page(items(spark, sf_dir), 100, 50).select("item_id", "path", "media_type")


# ------------------------------------------------------------------------------------------ bursts

_TIMED = r"""timed as (
  select item_id, regexp_replace(path, '/[^/]*$', '') as folder, coalesce(captured_at,
    cast(try_strptime(nullif(regexp_extract(file_name, '(?i)(?:IMG|VID|AUD)-(\d{8})-', 1), '') || ' 12', '%Y%m%d %H') as timestamptz),
    modified_at) as tm
  from media_items),
gaps as (select *, case when epoch_us(tm) - epoch_us(lag(tm) over w) <= 10000000 then 0 else 1 end as s
  from timed where tm is not null window w as (partition by folder order by tm, item_id)),
numbered as (select *, sum(s) over (partition by folder order by tm, item_id rows unbounded preceding) as g from gaps),
grouped as (select item_id, first_value(item_id) over w as group_id,
    cast(row_number() over w - 1 as int) as group_index, cast(count(*) over (partition by folder, g) as int) as group_size
  from numbered window w as (partition by folder, g order by tm, item_id))"""


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    at = grouping.capture_time(F.col("captured_at"), none, F.col("file_name"), F.col("modified_at"))
    return items(spark, sf_dir).select("item_id", "folder", at.alias("at"))


@query(f"with {_TIMED} select * from grouped")
def burst_sessions(spark, sf_dir):
    out = grouping.sessions(timed(spark, sf_dir), ["folder"], "at", "item_id", 10)
    return out.select("item_id", "group_id", "group_index", "group_size")


@query(
    f"""with {_TIMED} select count(*) as groups, min(group_size) as smallest, max(group_size) as largest,
  avg(group_size) as mean, cast(sum(group_size) as bigint) as items from grouped where group_index = 0 and group_size >= 2"""
)
def burst_session_stats(spark, sf_dir):
    return grouping.group_statistics(grouping.sessions(timed(spark, sf_dir), ["folder"], "at", "item_id", 10))


@query(
    """with gaps as (select event_id as item_id, ts as tm,
    case when epoch_us(ts) - epoch_us(lag(ts) over (order by ts, event_id)) <= 10000000 then 0 else 1 end as s from events),
numbered as (select *, sum(s) over (order by tm, item_id rows unbounded preceding) as g from gaps)
select item_id, first_value(item_id) over w as group_id, cast(row_number() over w - 1 as int) as group_index,
  cast(count(*) over (partition by g) as int) as group_size
from numbered window w as (partition by g order by tm, item_id)"""
)
def event_sessions(spark, sf_dir):
    """Sessions over the whole table at once, with no key to divide it by."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("ts").alias("at"))
    return grouping.sessions(rows, [], "at", "item_id", 10).select("item_id", "group_id", "group_index", "group_size")


def _document_sessions(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "document_features").select(
        F.col("feature_id").alias("item_id"), inventory.folder(F.col("path")).alias("folder"), F.col("extracted_at").alias("at"), "embedding"
    )
    return grouping.sessions(docs, ["folder"], "at", "item_id", 30 * 86_400)


@query(
    """select result_id, cast(floor(burst_index / 10) as int) as chunk,
  cast(coalesce(local_rank, burst_index % 10 + 1) + 10 * cast(floor(burst_index / 10) as int) as int) as global_rank
from latest_results where burst_id is not null and burst_index >= 0"""
)
def burst_chunk_ranks(spark, sf_dir):
    rows = judgements(spark, sf_dir, "burst_id", "burst_index", "local_rank").where("burst_id is not null and burst_index >= 0")
    return grouping.chunk_ranks(rows, "burst_index", "local_rank", 10).select("result_id", "chunk", "global_rank")


@query(
    """with r as (select *, coalesce(burst_size, 1) as s, coalesce(burst_index, -1) as i from latest_results),
n as (select result_id, s, i, sum(case when s > 1 and i = 0 then 1 else 0 end) over (order by result_id rows unbounded preceding) as no,
  max(case when s <= 1 then result_id end) over (order by result_id rows unbounded preceding) as closed,
  max(case when s > 1 and i = 0 then result_id end) over (order by result_id rows unbounded preceding) as opened from r)
select result_id, cast(case when s > 1 and opened is not null and opened > coalesce(closed, -1) then no end as bigint) as burst_no from n"""
)
def burst_islands(spark, sf_dir):
    rows = judgements(spark, sf_dir, "burst_size", "burst_index")
    return grouping.islands(rows, "result_id", "burst_size", "burst_index").select("result_id", "burst_no")


# ------------------------------------------------------------------------------------------ similarity

_VECTORS = """v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where embedding is not null),
p as (select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.e, b.e), 6) as cosine
  from v a join v b on a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.4)"""


@query(f"with {_VECTORS} select * from p")
def similar_pairs(spark, sf_dir):
    pairs = grouping.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 0.4)
    return pairs.withColumn("cosine", F.round("cosine", 6))


@query(
    f"""with recursive {_VECTORS},
l as (select a, b from p union all select b, a from p union all select vec_id, vec_id from v),
reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a as vec_id, min(b) as group_id from reach group by a)
select vec_id, group_id, count(*) over (partition by group_id) as group_size from c"""
)
def similarity_components(spark, sf_dir):
    return grouping.similarity_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 0.4)


@query(
    """with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where embedding is not null),
p as (select q.vec_id as vec_id, b.vec_id as other, round(list_cosine_similarity(q.e, b.e), 6) as cosine
  from v q join v b on q.vec_id <> b.vec_id where q.vec_id % 100 = 0)
select vec_id, other, cosine, cast(row_number() over (partition by vec_id order by cosine desc, other) as int) as rank from p
qualify rank <= 3"""
)
def similarity_search(spark, sf_dir):
    """The three nearest of every vector whose id is divisible by 100, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return grouping.nearest_of(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", 64, 3)


# ------------------------------------------------------------------------------------------ judgements

_LATEST = """latest_results as (
  select unnest(max_by(struct_pack(item_id, path, config_id, classification, destination, score, burst_id, burst_size, burst_index,
    local_rank, reasoning, contains_children, is_appropriate, is_error_fallback, error_type, retry_count, judged_at, loaded_at), loaded_at)),
    result_id
  from classification_results group by result_id)"""
_JUDGED = f"""with {_LATEST},
judged as (select *, case when trim(classification) in ('Share', 'Storage', 'Review', 'Ignore') then trim(classification) else 'Review' end as category,
  case when score is null then 2 else greatest(1, least(5, score)) end as points, coalesce(local_rank, burst_index + 1) as place from latest_results)"""
_GUARDS = """when category = 'Ignore' then 'Ignore' when contains_children = false then 'Ignore'
    when is_appropriate = false then 'Review' when category = 'Review' then 'Review'"""
_SINGLE = f"case {_GUARDS} when category = 'Share' and points >= 4 then 'Share' when points >= 3 then 'Review' else 'Storage' end"
ORACLES["burst_islands"] = f"with {_LATEST}, " + ORACLES["burst_islands"][len("with ") :]
ORACLES["burst_chunk_ranks"] = f"with {_LATEST} " + ORACLES["burst_chunk_ranks"]


def judgements(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Every judgement once, by its latest delivery, with the columns asked for; no others are read."""
    rows = table(spark, sf_dir, "classification_results").select("result_id", "loaded_at", *columns)
    return stats.latest(rows, "result_id", "loaded_at")


def judged(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    base = ["classification", "score", "burst_index", "local_rank"]
    rows = judgements(spark, sf_dir, *base, *(c for c in columns if c not in base))
    rows = rows.withColumn("category", F.trim("classification")).withColumn("points", F.col("score"))
    return validate.judgement(rows, "category", "points", VALID, "Review", rank="local_rank", position="burst_index")


@query(f"{_JUDGED} select category, points, count(*) as n from judged group by all")
def validated_scores(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("category", "points").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_JUDGED} select result_id, category, points, {_SINGLE} as destination from judged")
def route_single(spark, sf_dir):
    place = route.single(F.col("category"), F.col("points"), F.col("contains_children"), F.col("is_appropriate"))
    return judged(spark, sf_dir, "contains_children", "is_appropriate").select("result_id", "category", "points", place.alias("destination"))


@query(
    f"""{_JUDGED}, routed as (select {_SINGLE} as destination from judged)
select destination, count(*) as n, round(count(*) * 100.0 / (select count(*) from routed), 4) as percent from routed group by destination"""
)
def route_stats(spark, sf_dir):
    return stats.counts(route_single(spark, sf_dir), "destination")


@query(
    f"""{_JUDGED} select result_id, case {_GUARDS}
  when place <= 2 and points >= 4 then 'Share' when points >= 3 then 'Review' else 'Storage' end as destination
from judged where burst_id is not null"""
)
def route_burst(spark, sf_dir):
    rows = judged(spark, sf_dir, "burst_id", "contains_children", "is_appropriate").where("burst_id is not null")
    return route.burst(
        rows, "burst_id", "burst_index", "category", "points", "local_rank", "contains_children", "is_appropriate"
    ).select("result_id", "destination")


@query(
    f"""{_JUDGED} select j.result_id, case when category = 'Share' and points < c.share_threshold then 'Review'
  when category = 'Storage' and points < c.review_threshold then 'Review' else category end as destination
from judged j join classification_configs c using (config_id)"""
)
def route_by_profile(spark, sf_dir):
    """Routing by the thresholds of the row's own profile."""
    configs = table(spark, sf_dir, "classification_configs").select("config_id", "share_threshold", "review_threshold")
    rows = judged(spark, sf_dir, "config_id").join(configs, "config_id")
    limits = F.create_map(F.lit("Share"), F.col("share_threshold"), F.lit("Storage"), F.col("review_threshold"))
    valid = F.array(*map(F.lit, VALID))
    place = route.by_profile(F.col("category"), F.col("points"), limits, valid, F.lit("Review"))
    return rows.select("result_id", place.alias("destination"))


@query(
    """with t as (select config_id, unnest([{'category': 'Share', 'low': share_threshold}, {'category': 'Review', 'low': review_threshold}], recursive := true)
  from classification_configs)
select config_id, category, low, cast(coalesce(lag(low) over (partition by config_id order by low desc) - 1, 5) as int) as high from t"""
)
def score_ranges(spark, sf_dir):
    from pyspark.sql.window import Window

    t = table(spark, sf_dir, "classification_configs").select(
        "config_id", F.explode(F.create_map(F.lit("Share"), F.col("share_threshold"), F.lit("Review"), F.col("review_threshold"))).alias("category", "low")
    )
    above = F.lag("low").over(Window.partitionBy("config_id").orderBy(F.desc("low")))
    return t.withColumn("high", F.coalesce(above - 1, F.lit(5)))


@query(
    f"""{_JUDGED} select result_id, points, case when length(reasoning) > 60 then reasoning[:57] || '...' else reasoning end as reason
from judged where score > 0 and not coalesce(is_error_fallback, false) order by points desc, result_id limit 5"""
)
def top_scored(spark, sf_dir):
    rows = judged(spark, sf_dir, "reasoning", "is_error_fallback").where("score > 0")
    top = stats.top_scored(rows, "points", "result_id", "is_error_fallback")
    return top.select("result_id", "points", stats.shortened(F.col("reasoning")).alias("reason"))


@query(
    f"""with {_LATEST} select coalesce(destination, '(none)') as destination, count(*) as n,
  round(count(*) * 100.0 / (select count(*) from latest_results), 4) as percent from latest_results group by 1"""
)
def destination_counts(spark, sf_dir):
    return stats.counts(judgements(spark, sf_dir, "destination"), "destination", "(none)")


@query(
    f"""with {_LATEST} select config_id, count(*) as results, count(distinct item_id) as items, count(*) filter (is_error_fallback) as errors,
  round(avg(score), 6) as mean_score, count(distinct burst_id) as bursts from latest_results group by config_id"""
)
def profile_summary(spark, sf_dir):
    return judgements(spark, sf_dir, "config_id", "item_id", "is_error_fallback", "score", "burst_id").groupBy("config_id").agg(
        F.count(F.lit(1)).alias("results"), F.count_distinct("item_id").alias("items"), F.count_if("is_error_fallback").alias("errors"),
        F.round(F.avg("score"), 6).alias("mean_score"), F.count_distinct("burst_id").alias("bursts"),
    )


def _replies(spark, sf_dir) -> DataFrame:
    """Replies as judges write them: plain, fenced, in prose, or no JSON at all."""
    flat = F.to_json(F.struct(F.col("classification"), F.col("score"), F.lit("ok").alias("reasoning")))
    kind = F.pmod("result_id", F.lit(4))
    text = (
        F.when(kind == 0, flat).when(kind == 1, F.concat(F.lit("```json\n"), flat, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here you are: "), flat, F.lit(" - done."))).otherwise("I cannot judge this.")
    )
    return judgements(spark, sf_dir, "classification", "score").where("score is not null").select("result_id", text.alias("text"))


@query(
    f"""with {_LATEST} select result_id, case when result_id % 4 < 3 then score end as score,
  case when result_id % 4 < 3 then classification end as category from latest_results where score is not null"""
)
def judgement_parse(spark, sf_dir):
    rows = _replies(spark, sf_dir).select("result_id", validate.lenient_json(F.col("text")).alias("j"))
    return rows.select(
        "result_id", F.try_variant_get("j", "$.score", "int").alias("score"), F.try_variant_get("j", "$.classification", "string").alias("category")
    )


@query(
    r"""with n as (select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name || '''s (' || p_name || ')! ' || p_name),
  '''s\b', '', 'g'), '[()]', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as n from part)
select p_partkey, nullif(case when length(n) > 40 then regexp_replace(n[:40], '_[^_]*$', '') else n end, '') as name from n"""
)
def dimension_names(spark, sf_dir):
    p = F.col("p_name")
    long = F.concat(p, F.lit("'s ("), p, F.lit(")! "), p)
    return table(spark, sf_dir, "part").select("p_partkey", validate.dimension_name(long).alias("name"))


# ------------------------------------------------------------------------------------------ labels

_PAIRS = """latest_pairs as (
  select pair_id, unnest(max_by(struct_pack(session_id, photo_a, photo_b, choice, comparison_type, weight), loaded_at)) from pairwise_comparisons group by pair_id),
pairs as (select pair_id, session_id, photo_a, photo_b, comparison_type,
  case when lower(trim(choice)) in ('left', 'right', 'both', 'neither') then lower(trim(choice)) end as choice from latest_pairs)"""
_VOTES = f"""with {_PAIRS},
votes as (
  select photo_a as item, case choice when 'left' then 'share' when 'both' then 'share' else 'storage' end as side,
    case choice when 'left' then 0.95 when 'right' then 0.85 else 0.9 end as conf from pairs where choice is not null
  union all
  select photo_b, case choice when 'right' then 'share' when 'both' then 'share' else 'storage' end,
    case choice when 'right' then 0.95 when 'left' then 0.85 else 0.9 end from pairs where choice is not null),
best as (select item, max(case when side = 'share' then conf end) as s, max(case when side = 'storage' then conf end) as t
  from votes where item is not null group by item),
labelled as (select item, case when s is not null and (t is null or s >= t) then 'share' else 'storage' end as side,
  cast(case when s is not null and (t is null or s >= t) then s else t end as double) as confidence from best)"""


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comparison once, with a clean choice or none."""
    rows = table(spark, sf_dir, "pairwise_comparisons").select("pair_id", "session_id", "photo_a", "photo_b", "choice", "comparison_type", "loaded_at")
    return stats.latest(rows, "pair_id", "loaded_at").withColumn("choice", labels.clean_choice(F.col("choice")))


def _labelled(spark, sf_dir) -> DataFrame:
    return labels.labels(comparisons(spark, sf_dir), "photo_a", "photo_b", "choice")


@query(f"{_VOTES} select * from labelled")
def pairwise_labels(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query(
    f"""{_VOTES}, capped as (select *, row_number() over (order by confidence desc, item) as r from labelled where side = 'storage')
select item, side, confidence from labelled where side = 'share'
union all select item, side, confidence from capped where r <= 3 * (select count(*) from labelled where side = 'share')"""
)
def balanced_labels(spark, sf_dir):
    """The stored side cut to three times the shared one."""
    return labels.balanced(_labelled(spark, sf_dir))


@query(
    f"""with {_PAIRS},
s as (select session_id, max_by(total_files, updated_at) as total_files from training_sessions group by session_id),
n as (select session_id, count(*) as comparisons, count(*) filter (comparison_type = 'within_burst') as within_burst,
    count(*) filter (comparison_type = 'between_burst') as between_burst, count(*) filter (choice = 'left') as chose_left,
    count(*) filter (choice = 'right') as chose_right, count(*) filter (choice = 'both') as chose_both, count(*) filter (choice = 'neither') as chose_neither
  from pairs where choice is not null group by session_id),
l as (select session_id, count(distinct item) as labelled from (
    select session_id, photo_a as item from pairs where choice is not null union all select session_id, photo_b from pairs where choice is not null) group by session_id)
select s.session_id, coalesce(comparisons, 0) as comparisons, coalesce(within_burst, 0) as within_burst, coalesce(between_burst, 0) as between_burst,
  coalesce(chose_left, 0) as chose_left, coalesce(chose_right, 0) as chose_right, coalesce(chose_both, 0) as chose_both, coalesce(chose_neither, 0) as chose_neither,
  coalesce(labelled, 0) as labelled, case when total_files > 0 then round_even(100.0::double * coalesce(labelled, 0) / total_files, 1) else 0.0 end as coverage,
  coalesce(comparisons, 0) >= 15 as ready
from s left join n using (session_id) left join l using (session_id)"""
)
def session_stats(spark, sf_dir):
    newest = F.max_by("total_files", "updated_at").alias("total_files")
    sessions = table(spark, sf_dir, "training_sessions").groupBy("session_id").agg(newest)
    return labels.session_stats(comparisons(spark, sf_dir), sessions)


_BURSTS = f"""with {_PAIRS},
s as (select session_id, max_by(bursts, updated_at) as bursts from training_sessions group by session_id),
m as (select session_id, b.no as burst_no, unnest(b.files) as item from (
  select session_id, unnest(list_transform(bursts, lambda x, i: struct_pack(no := i - 1, files := x))) as b from s)),
done as (select distinct session_id, item from (
  select session_id, photo_a as item from pairs where choice is not null union all select session_id, photo_b from pairs where choice is not null)),
free as (select distinct session_id, burst_no, item from m anti join done using (session_id, item))"""


@query(f"{_BURSTS} select session_id, cast(burst_no as int) as burst_no, count(*) as unlabelled from free group by all having count(*) >= 2")
def burst_candidates(spark, sf_dir):
    """Bursts from which the next comparison can be drawn."""
    newest = F.max_by("bursts", "updated_at").alias("bursts")
    sessions = table(spark, sf_dir, "training_sessions").groupBy("session_id").agg(newest)
    bursts = sessions.select("session_id", F.posexplode("bursts").alias("burst_no", "files")).select("session_id", "burst_no", F.explode("files").alias("item"))
    done = comparisons(spark, sf_dir).where("choice is not null").select("session_id", F.explode(F.array("photo_a", "photo_b")).alias("item"))
    return labels.burst_candidates(bursts, done.distinct())


@query(
    f"""{_VOTES}, t as (select item, side, confidence, case when {_KIND.replace('path', 'item')} is null then 'none' else {_KIND.replace('path', 'item')} end as kind from labelled)
select kind, side, count(*) as n, round(avg(confidence), 6) as confidence from t group by all"""
)
def labels_by_type(spark, sf_dir):
    kind = F.coalesce(inventory.media_type(F.col("item")), F.lit("none"))
    return _labelled(spark, sf_dir).groupBy(kind.alias("kind"), "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


# ------------------------------------------------------------------------------------------ corrections, recovery, cache

_MOVES = f"""with {_LATEST},
f as (select item_id, min_by(destination, struct_pack(judged_at, result_id)) as was, max_by(destination, struct_pack(judged_at, result_id)) as now
  from latest_results where destination is not null group by item_id)"""


def _first_last(spark, sf_dir) -> DataFrame:
    rows = judgements(spark, sf_dir, "item_id", "destination", "judged_at").where("destination is not null")
    at = F.struct("judged_at", "result_id")
    return rows.groupBy("item_id").agg(F.min_by("destination", at).alias("was"), F.max_by("destination", at).alias("now"))


@query(f"{_MOVES} select item_id, was, now from f where was <> now")
def moved_items(spark, sf_dir):
    """Items whose last place differs from the one first reported."""
    both = _first_last(spark, sf_dir)
    return labels.moves(both.select("item_id", "was"), both.select("item_id", "now"), "item_id", "was", "now")


@query(f"{_MOVES} select was, now, count(*) as n from f where was <> now group by all")
def move_transitions(spark, sf_dir):
    return labels.transitions(moved_items(spark, sf_dir), "was", "now")


@query(
    f"""with {_LATEST} select error_type, coalesce(nullif(burst_id, ''), 'singleton_' || path) as failed_group, count(*) as n
from latest_results where is_error_fallback and error_type in ('api_error', 'invalid_response', 'load_error') group by all"""
)
def failed_groups(spark, sf_dir):
    rows = grouping.failed_groups(recover.failed(judgements(spark, sf_dir, "path", "burst_id", "is_error_fallback", "error_type")), "burst_id", "path")
    return rows.groupBy("error_type", "failed_group").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {_LATEST}, u as (select case when burst_id is null or burst_id = '' then 'item-' || result_id else burst_id end as unit,
  burst_id is null or burst_id = '' as alone, coalesce(is_error_fallback, false) as e from latest_results)
select unit, case when alone then 'single' when count(*) = count(*) filter (e) then 'whole' else 'members' end as mode, count(*) filter (e) as items
from u group by unit, alone having count(*) filter (e) > 0"""
)
def reprocess_plan(spark, sf_dir):
    return recover.reprocess_plan(judgements(spark, sf_dir, "burst_id", "is_error_fallback"), "burst_id", "result_id", "is_error_fallback")


@query(
    f"""with {_LATEST}, r as (select result_id, nullif(burst_id, '') as burst_id, coalesce(is_error_fallback, false) as e from latest_results),
h as (select distinct burst_id from r where e and burst_id is not null)
select result_id, case when e then 'error' else 'burst' end as reason from r
where burst_id in (select burst_id from h) or (burst_id is null and e)"""
)
def clear_plan(spark, sf_dir):
    return recover.clear_plan(judgements(spark, sf_dir, "burst_id", "is_error_fallback"), "burst_id", "result_id", "is_error_fallback")


_CACHE = """c as (select path, sha256(path || '_' || size_bytes || '_' || epoch_us(modified_at)) as key, size_bytes, modified_at, item_id from media_items)"""


def _keys(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "media_items")
    stamp = F.unix_micros(F.col("modified_at").cast("timestamp"))
    return rows.select("item_id", "path", "size_bytes", "modified_at", media.file_key(F.col("path"), F.col("size_bytes"), stamp).alias("key"))


@query(f"with {_CACHE} select item_id, key, item_id % 3 <> 0 as hit from c where size_bytes is not null and modified_at is not null")
def cache_probe(spark, sf_dir):
    """Which items the cache answers, where it holds all but every third."""
    keys = _keys(spark, sf_dir).where("size_bytes is not null and modified_at is not null")
    hits, misses = recover.probe(keys.select("item_id", "key"), keys.where("item_id % 3 <> 0").select("key"), "key")
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))


@query("""select item_id, coalesce(epoch_us(timestamptz '2025-06-01 00:00:00+00') - epoch_us(modified_at) > 365 * 86400000000, true) as expired from media_items""")
def cache_expired(spark, sf_dir):
    as_of = F.lit("2025-06-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "media_items").select("item_id", media.expired(F.col("modified_at"), as_of, 365).alias("expired"))


@query(
    """with t as (select cast(sum(size_bytes) as bigint) as total from media_items where modified_at is not null),
r as (select item_id, size_bytes, sum(size_bytes) over (order by modified_at, item_id rows unbounded preceding) - size_bytes as before
  from media_items where modified_at is not null)
select item_id, (select total from t) - before > (select total // 2 from t) * 0.9 as evicted from r"""
)
def cache_evict(spark, sf_dir):
    """What goes, oldest first, where half of all bytes may stay."""
    files = table(spark, sf_dir, "media_items").where("modified_at is not null").select("item_id", "size_bytes", "modified_at")
    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    return stats.evict(files, "size_bytes", "modified_at", "item_id", total // 2).select("item_id", "evicted")


@query(f"with {_FILES} select kind as store, cast(sum(size_bytes) as bigint) as bytes, count(*) as entries from files where kind is not null group by rollup (kind)")
def cache_sizes(spark, sf_dir):
    return stats.sizes(items(spark, sf_dir).where("media_type is not null").withColumnRenamed("media_type", "store"), "store", "size_bytes")


# ------------------------------------------------------------------------------------------ texts and features


@query(
    r"""select doc_id, cast(length(text) as bigint) as text_length, cast(least(length(text), 50000) as bigint) as kept_length,
  cast(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) as bigint) as word_count, cast(length(text) // 4 as bigint) as tokens
from documents where text is not null"""
)
def document_features(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", F.length(t).cast("long").alias("text_length"), F.length(media.kept_text(t)).cast("long").alias("kept_length"),
        media.word_count(t).alias("word_count"), media.token_estimate(t).alias("tokens"),
    )


@query(
    """select doc_id, case when length(text) > 30000 then text[:30000] || chr(10) || '[... cut ...]' else text end as text,
  '[' || coalesce(source, 'none') || ']' || chr(10) || text[:2000] as preview from documents where text is not null"""
)
def document_previews(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", media.marked_cut(t, prompts.SINGLE_CHARS).alias("text"), media.preview(F.coalesce("source", F.lit("none")), t).alias("preview")
    )


def _page(text: Column) -> Column:
    """A page around ``text`` whose style and script hold markup."""
    body = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = '<html><head><style>p {x: "<b>"}</style><script>var t = "</p>";</script></head><body><p>'
    return F.concat(F.lit(head), body, F.lit("</p></body></html>"))


#: What str.isspace() holds, as html.parser's texts are stripped of it; said by code points, since \s differs between engines.
_BLANKS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\p{Z}]+"


@query(f"""select doc_id, trim(regexp_replace(text, '{_BLANKS}', ' ', 'g')) as text from documents where text is not null""")
def html_text(spark, sf_dir):
    """Text of pages whose scripts hold markup, of every document in any script, compared after joining white space."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    out = html.with_html_text(docs.select("doc_id", _page(F.col("text")).alias("page")), "page")
    return out.select("doc_id", F.trim(F.regexp_replace("text", _BLANKS, " ")).alias("text"))


@query(
    """with f as (select item_id, cast(size_bytes % 40 as int) as n, cast(size_bytes % 1000 as int) as w, cast(size_bytes // 1000 % 1000 as int) as h
  from media_items where size_bytes is not null)
select item_id, case when n <= 0 then [] when n <= 8 then list_transform(range(n), lambda i: cast(i as int))
    else list_transform(range(8), lambda i: cast(floor(cast(n as double) / 8 * i) as int)) end as frames,
  case when w > 0 and h > 0 then list_min([{'off': abs(w / h - 1.0), 'i': 0, 'n': '1:1'},
    {'off': abs(w / h - 2/3), 'i': 1, 'n': '2:3'},
    {'off': abs(w / h - 3/2), 'i': 2, 'n': '3:2'},
    {'off': abs(w / h - 3/4), 'i': 3, 'n': '3:4'},
    {'off': abs(w / h - 4/3), 'i': 4, 'n': '4:3'},
    {'off': abs(w / h - 9/16), 'i': 5, 'n': '9:16'},
    {'off': abs(w / h - 16/9), 'i': 6, 'n': '16:9'},
    {'off': abs(w / h - 21/9), 'i': 7, 'n': '21:9'}]).n end as ratio,
  case when greatest(w, h) > 512 then cast(floor(w * (512.0::double / greatest(w, h))) as int) else w end as width
from f"""
)
def image_arithmetic(spark, sf_dir):
    """Frame choice, nearest aspect ratio and scaled size, from sizes standing in for pixels."""
    s = F.col("size_bytes")
    n, w, h = (s % 40).cast("int"), (s % 1000).cast("int"), (F.floor(s / 1000) % 1000).cast("int")
    return table(spark, sf_dir, "media_items").where("size_bytes is not null").select(
        "item_id", media.frame_indices(n, 8).alias("frames"), media.closest_ratio(w, h).alias("ratio"), media.fitted_size(w, h, 512)["width"].alias("width")
    )


@query(
    """with f as (select item_id, cast(size_bytes % 400 as double) as s, cast(size_bytes % 256 as double) as b from media_items)
select item_id, round(q, 9) as quality, q >= 0.3 as passes
from (select item_id, case when s is null then 0.0 else least(s / 200.0, 1.0) * 0.8 + b / 255.0 * 0.2 end as q from f)"""
)
def quality_filter(spark, sf_dir):
    q = media.quality((F.col("size_bytes") % 400).cast("double"), (F.col("size_bytes") % 256).cast("double"))
    return table(spark, sf_dir, "media_items").select("item_id", F.round(q, 9).alias("quality"), media.passes_quality(q).alias("passes"))


# ------------------------------------------------------------------------------------------ streams


@query(
    """with gaps as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) <= 600000000 then 0 else 1 end as s from events),
n as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as g from gaps),
w as (select user_id, min(ts) as started_at, max(ts) as last_at, count(*) as items from n group by user_id, g)
select user_id, started_at::timestamptz as started_at, last_at::timestamptz as last_at, items from w
where epoch_us(last_at) + 600000000 <= (select epoch_us(max(ts)) - 3600000000 from events)"""
)
def stream_sessions(spark, sf_dir):
    """The stream form of the sessions: those that the watermark has closed after all there is was read."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/events.parquet*")
    return streaming.run_available(streaming.stream_sessions(stream, "user_id", "ts", "10 minutes"))


# ------------------------------------------------------------------------------------------ feedback


def _feedback(spark, sf_dir) -> DataFrame:
    """The judgements of every config read as corrections."""
    rows = judgements(spark, sf_dir, "path", "classification", "reasoning", "judged_at")
    return rows.select(
        F.col("path").alias("file_path"), F.nullif(F.trim("classification"), F.lit("Ignore")).alias("correct_category"), "reasoning",
        F.col("judged_at").alias("submitted_at"), "result_id",
    )


_FEEDBACK = f"""with {_LATEST}, f as (select path as file_path, nullif(trim(classification), 'Ignore') as correct_category, reasoning, judged_at as submitted_at
  from latest_results),
n as (select coalesce(correct_category, 'unknown') as category, * from f)"""


@query(
    f"""{_FEEDBACK},
r as (select category, reasoning, row_number() over (partition by category order by submitted_at nulls first, file_path nulls first, reasoning) as k from n where trim(reasoning) <> ''),
l as (select category, list(reasoning order by k) as reasons from r where k <= 20 group by category)
select category, count(*) as n, any_value(coalesce(l.reasons, [])) as reasons from n left join l using (category) group by category"""
)
def feedback_reasons(spark, sf_dir):
    """Corrections per category with their first reasons."""
    return labels.reasons_by_category(_feedback(spark, sf_dir))


@query(
    f"""{_FEEDBACK} select file_path, correct_category, submitted_at from f
order by submitted_at desc nulls last, file_path desc nulls last, correct_category desc nulls last limit 20"""
)
def feedback_recent(spark, sf_dir):
    """The last corrections."""
    return labels.recent(_feedback(spark, sf_dir)).select("file_path", "correct_category", "submitted_at")


@query(
    f"""with {_LATEST}, r as (select result_id, trim(classification) as category, row_number() over (partition by trim(classification) order by result_id) as k,
  count(*) over (partition by trim(classification)) as c from latest_results)
select result_id, category from r where k <= 3 * (select min(c) from r)"""
)
def balanced_categories(spark, sf_dir):
    rows = judgements(spark, sf_dir, "classification").select("result_id", F.trim("classification").alias("category"))
    return labels.balanced_categories(rows, "category", [F.col("result_id")])


@query(
    f"""{_MOVES}, m as (select * from f where was <> now),
k as (select item_id, min(trim(classification)) as category from latest_results group by item_id)
select item_id, now as category, case when was in ('Share', 'Storage') and now in ('Share', 'Storage') then 5 else 4 end as confidence, 'move' as source from m
union all select item_id, category, 3, 'known' from k where item_id not in (select item_id from m)"""
)
def correction_table(spark, sf_dir):
    """Corrections: moves take the place of what was known of every judged item."""
    known = judgements(spark, sf_dir, "item_id", "classification").groupBy("item_id").agg(F.min(F.trim("classification")).alias("category"))
    return labels.corrections(moved_items(spark, sf_dir), known.withColumn("confidence", F.lit(3)), "item_id", "was", "now")
