"""Problem 6: a varied subset of given size that avoids records similar to each other.

Method: minimum-cost flow quotas. Records are counted by combinations of two categories (region of the vector space and
a column); a flow with balanced targets per category and convex penalties for overuse says how many each combination
gives; combinations are filled by a deterministic rank. Of records joined by similarities of the threshold or more, one
is fresh and the others are repeats, which the flow takes only if nothing else is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.clusters import _nearest, kmeans, similarity_links
from gleanery.llm.quotas import balanced_quotas
from gleanery.llm.vectors import matrix, unit, usable
from gleanery.operators.components import connected_components
from gleanery.operators.ranking import global_rank
from gleanery.scratch import Scratch


def varied_subset(
    df: DataFrame, id_col: str, vec_col: str, part_col: str, by_col: str, dim: int, plan: dict[int, tuple[int, float]],
    regions: int = 24, max_values: int = 64,
) -> DataFrame:
    """(part, id, region, value, repeated): plan[part] = (size, threshold); of each part in the plan ``size`` records.

    region is the nearest of ``regions`` k-means centres, value the column ``by_col`` (the ``max_values`` most frequent
    ones, the rest and null as '(other)'). Records without a usable vector (null, zero, non-finite, other length) have
    no place in the variety: they are taken last, as region -1, if the others do not reach the size. Ids are unique
    within a part (repeated rows count once); ties go by the hash of the id, then the id; parts outside the plan, null
    parts and extra columns are ignored; an empty table gives an empty result. Only counts per combination (parts x
    regions x values) reach the driver.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    rows = df.select(
        F.col(part_col).cast("long").alias("part"), F.col(id_col).cast("long").alias("id"),
        F.col(by_col).cast("string").alias("value"), F.col(vec_col).cast("array<float>").alias("vec"),
    ).where(F.col("part").isin(list(plan)) & F.col("id").isNotNull())
    shape = "part long, id long, region long, value string, repeated boolean"
    if not plan:
        return spark.createDataFrame([], shape)
    cuts = F.create_map(*[x for p, (_, cut) in plan.items() for x in (F.lit(p).cast("long"), F.lit(float(cut)))])
    good = rows.where(usable(F.col("vec"), dim)).select(
        "part", F.col("id").alias("rep"), "vec", F.element_at(cuts, F.col("part")).alias("cut"), "value"
    )
    # copies within a part stand behind their smallest id
    marked = good.withColumn("f", F.xxhash64("vec")).withColumn("g", F.xxhash64(F.lit("second"), "vec"))
    points = scratch.keep(
        marked.groupBy("part", "f", "g").agg(
            F.min("rep").alias("rep"), F.min_by("vec", "rep").alias("vec"), F.first("cut").alias("cut")
        )
    )
    links = scratch.keep(similarity_links(points, dim))
    # ids may occur in several parts, hence components over (part, id)
    node = lambda c: F.struct(F.col("part"), F.col(c).alias("id"))
    labels = connected_components(links.select(node("rep").alias("x"), node("hub").alias("y")), "x", "y")
    labels = labels.select(F.col("node.part").alias("part"), F.col("node.id").alias("rep"), F.col("component.id").alias("head"))

    centres = kmeans(points.select("rep", "vec"), dim, regions)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _nearest(unit(matrix(b.column("vec"), dim)), centres)[0] if b.num_rows and len(centres) else np.zeros(0, np.int64)
            keep = [b.column(c) for c in ("part", "f", "g", "rep")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(at)], ["part", "f", "g", "rep", "region"])

    placed = points.select("part", "f", "g", "rep", "vec").mapInArrow(place, "part long, f long, g long, rep long, region long")
    classes = placed.join(labels, ["part", "rep"], "left").select(
        "part", "f", "g", "region", F.coalesce("head", "rep").alias("head")
    )
    tied = marked.select("part", "f", "g", F.col("rep").alias("id"), "value").join(classes, ["part", "f", "g"])
    tied = tied.select("part", "id", "region", "value", (F.col("id") != F.col("head")).alias("repeated"))
    rest = rows.where(~usable(F.col("vec"), dim)).select(
        "part", "id", F.lit(-1).cast("long").alias("region"), "value", F.lit(True).alias("repeated")
    )
    common = rows.groupBy("value").count().where("value is not null").orderBy(F.desc("count"), "value").limit(max_values)
    names = [r["value"] for r in common.collect()]
    value = F.when(F.col("value").isin(names), F.col("value")).otherwise("(other)")
    every = scratch.keep(tied.unionByName(rest).withColumn("value", value).dropDuplicates(["part", "id"]))

    table = every.groupBy("part", "region", "value").agg(
        F.count_if(~F.col("repeated")).alias("fresh"), F.count_if("repeated").alias("repeats")
    )
    by_part: dict[int, dict] = {}
    for r in table.collect():  # parts x regions x values rows
        by_part.setdefault(r["part"], {})[(r["region"], r["value"])] = (r["fresh"], r["repeats"])
    quotas = [
        (part, region, value, int(q))
        for part, cells in by_part.items()
        for (region, value), q in balanced_quotas(cells, plan[part][0]).items() if q > 0
    ]
    if not quotas:
        return spark.createDataFrame([], shape)
    wanted = spark.createDataFrame(quotas, "part long, region long, value string, quota long")
    combo = ["part", "region", "value"]
    order = [*map(F.col, combo), F.col("repeated"), F.xxhash64("id"), F.col("id")]
    ranked = scratch.keep(global_rank(every, order, "place"))
    starts = ranked.groupBy(*combo).agg(F.min("place").alias("start"))
    limits = F.broadcast(wanted.join(starts, combo))  # parts x regions x values rows
    return ranked.join(limits, combo).where(F.col("place") - F.col("start") < F.col("quota")).select(
        "part", "id", "region", "value", "repeated"
    )


def p6_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The varied subset of the files of every config with the diversity check on; its size is the target share rate
    times the config's number of rows, rounded to the nearest."""
    files = spark.read.parquet(f"{sf_dir}/document_features.parquet")
    configs = spark.read.parquet(f"{sf_dir}/classification_configs.parquet").where("enable_diversity_check")
    held = files.groupBy("config_id").count()
    size = F.floor(F.coalesce("target_share_rate", F.lit(0.0)) * F.col("count") + 0.5).cast("long")
    cut = F.coalesce("diversity_similarity_threshold", F.lit(0.95))
    cut = F.when(F.isnan(cut), 0.95).otherwise(cut)
    plan = {r["config_id"]: (r["size"], r["cut"]) for r in configs.join(held, "config_id").select("config_id", size.alias("size"), cut.alias("cut")).collect()}
    return varied_subset(files, "feature_id", "embedding", "config_id", "file_format", 64, plan).select(
        F.col("part").cast("int").alias("config_id"), F.col("id").alias("feature_id"), "region",
        F.col("value").alias("file_format"), "repeated",
    )
