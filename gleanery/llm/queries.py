"""The queries of the training-data operators, and the SQL they are checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import clusters, leaks, mixing, neardup, neighbours, pairwise, subset, topn, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": clusters.p1_found,
    "p1_typical": clusters.p1_typical,
    "p1_sessions": clusters.p1_sessions,
    "p2_found": neighbours.p2_found,
    "p3_found": neardup.p3_found,
    "p3_groups": neardup.p3_groups,
    "p4_found": topn.p4_found,
    "p4_ranked": topn.p4_ranked,
    "p5_found": pairwise.p5_found,
    "p5_ranking": pairwise.p5_ranking,
    "p6_subset": subset.p6_subset,
    "p7_found": leaks.p7_found,
    "p7_coverage": leaks.p7_coverage,
    "p8_copies": mixing.p8_copies,
    "p8_shares": mixing.p8_shares,
    "p9_found": truncation.p9_found,
    "p9_rates": truncation.p9_rates,
}

_COSINES = """
usable as (
  select feature_id, list_transform(embedding, lambda x: cast(x as double)) as v from document_features
  where embedding is not null and len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select a.feature_id as a, b.feature_id as b, round(list_cosine_similarity(a.v, b.v), 9) as c
  from usable a join usable b on a.feature_id <> b.feature_id
  where list_cosine_similarity(a.v, b.v) >= 0.8499)
"""

_CLUSTERS = f"""with recursive {_COSINES},
links as (select a, b from pairs where c >= 0.85 union all select feature_id, feature_id from usable),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
tagged as (select a as feature_id, min(b) as cluster_key from reach group by a)
"""

_BEST = """with latest as (
  select burst_id, item_id, score, local_rank,
    row_number() over (partition by burst_id, item_id order by judged_at desc nulls last, result_id desc nulls last,
      loaded_at desc nulls last) as k
  from classification_results where burst_id is not null and item_id is not null),
ranked as (
  select burst_id, item_id, least(greatest(score, 1), 5) as score,
    row_number() over (partition by burst_id order by least(greatest(score, 1), 5) desc, local_rank asc nulls last, item_id)
      as rank
  from latest where k = 1 and score is not null)
"""

ORACLES: dict[str, str] = {
    "p1_found": f"""{_CLUSTERS}
select cluster_key, feature_id from tagged
where cluster_key in (select cluster_key from tagged group by cluster_key having count(*) >= 3)""",
    "p1_typical": f"""{_CLUSTERS},
sized as (select *, count(*) over (partition by cluster_key) as size from tagged qualify size >= 3),
units as (select cluster_key, size, feature_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from sized join usable using (feature_id)),
flat as (select cluster_key, unnest(u) as x, generate_subscripts(u, 1) as k from units),
sums as (select cluster_key, k, sum(x) as s from flat group by all),
centres as (select cluster_key, list(s order by k) as c from sums group by cluster_key),
scored as (select cluster_key, size, feature_id, round(list_cosine_similarity(u, c), 6) as cosine from units join centres using (cluster_key))
select cluster_key, size, cast(row_number() over (partition by cluster_key order by cosine desc, feature_id) as int) as rank, feature_id, cosine from scored qualify rank <= 3""",
    "p1_sessions": f"""{_CLUSTERS},
paths as (select distinct path, cluster_key from document_features join tagged using (feature_id)),
s as (select session_id, unnest(max_by(struct_pack(bursts, singletons), updated_at)) from training_sessions group by session_id),
listed as (
  select session_id, cast(b.no as int) as burst_no, unnest(b.files) as path from (
    select session_id, unnest(list_transform(bursts, lambda x, i: struct_pack(no := i - 1, files := x))) as b from s)
  union all select session_id, -1, unnest(singletons) from s)
select session_id, burst_no, count(distinct path) as files, count(distinct cluster_key) as clusters from listed join paths using (path) group by all""",
    "p2_found": f"""with {_COSINES},
ranked as (select a, b, row_number() over (partition by a order by c desc, b) as r from pairs where c >= 0.85)
select distinct least(a, b) as feature_a, greatest(a, b) as feature_b from ranked where r <= 5""",
    "p3_found": """with tokens as (
  select feature_id, regexp_extract_all(lower(text_content), '[\\p{L}\\p{N}]+') as w from document_features
  where text_content is not null),
sh as (
  select distinct feature_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s
  from tokens where len(w) >= 3),
sizes as (select feature_id, count(*) as n from sh group by feature_id),
common as (
  select a.feature_id as a, b.feature_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.feature_id < b.feature_id
  group by 1, 2)
select a as feature_a, b as feature_b from common
join sizes x on x.feature_id = a join sizes y on y.feature_id = b
where c * 10 >= 7 * (x.n + y.n - c)""",
    "p4_found": f"""{_BEST}
select burst_id, item_id from ranked where rank <= 3""",
    "p4_ranked": f"""{_BEST}
select burst_id, r.item_id, score, cast(rank as int) as rank, regexp_replace(m.path, '/[^/]*$', '') as folder
from ranked r left join media_items m on m.item_id = r.item_id where rank <= 10""",
    "p7_found": """with d as (
  select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
e as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items where text is not null),
dr as (select doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) as run
  from d where len(w) >= 10),
er as (select item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) as run
  from e where len(w) >= 10)
select distinct doc_id, item_id from dr join er using (run)""",
    "p3_groups": """with recursive tokens as (
  select feature_id, regexp_extract_all(lower(text_content), '[\\p{L}\\p{N}]+') as w from document_features where text_content is not null),
sh as (
  select distinct feature_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s
  from tokens where len(w) >= 5),
sets as (select feature_id, list_sort(list(s)) as l, count(*) as n from sh group by feature_id),
members as (select feature_id, min(feature_id) over (partition by l) as rep, n from sets),
copies as (select rep, count(*) as copies, any_value(n) as n from members group by rep),
common as (
  select a.feature_id as a, b.feature_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.feature_id < b.feature_id
  where a.feature_id in (select rep from copies) and b.feature_id in (select rep from copies) group by 1, 2),
links as (select a, b from common join copies x on x.rep = a join copies y on y.rep = b where c >= 0.8 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links union all select rep, rep from copies),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
grouped as (select a as rep, min(b) as group_id from reach group by a),
linked as (select a as rep, count(*) as links from (select a from links union all select b from links) group by a)
select feature_id, group_id, rep as class_id, coalesce(links, 0) as links
from members join copies using (rep) join grouped using (rep) left join linked using (rep)
where copies > 1 or links is not null""",
}
