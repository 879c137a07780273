"""Connected components of a link table, distributed and without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.scratch import Scratch


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in ``links``; the component is its smallest node.

    Alternates large-star and small-star steps until nothing changes, which takes O(log^2 n) rounds. Neighbour
    minima are aggregates with map-side combine and the joins on a hub key are left to AQE's skew handling, so a
    component holding a third of all nodes needs no task of its own. Each round is written to the shared folder.

    Links with a null end are ignored, a link of a node with itself makes it a component of its own, repeated
    links count once, an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(links.sparkSession)
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    nodes = scratch.keep(
        pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    )
    edges, before = nodes, None
    for _ in range(max_rounds):
        both = edges.where("x <> y").select("x", "y").union(edges.where("x <> y").select(F.col("y"), F.col("x")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.where("x <> y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x")
        step = small.select("x", F.col("m").alias("y")).union(
            small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        )
        new = scratch.keep(step.distinct())
        mark = tuple(new.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(x, y))"), F.expr("sum(xxhash64(y, x) % 1000003)")).first())
        if edges is not nodes:
            scratch.drop(edges)
        edges = new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = nodes.select(F.col("x").alias("node")).union(nodes.select("y")).distinct()
    return ends.join(edges.withColumnRenamed("x", "node"), "node", "left").select(
        "node", F.coalesce("y", "node").alias("component")
    )


