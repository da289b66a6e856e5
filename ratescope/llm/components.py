"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratescope.runtime import settle


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)),
        F.sum(F.xxhash64("high", "low").cast("decimal(20,0)")),
    ).first()
    return tuple(row)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """One row (node, component) per node that has a link; component is the smallest node reachable.

    Both stars replace links by links to the smallest neighbour. The smallest neighbour is an
    aggregate (partial sums per task), and only joins carry the links themselves, so a node with
    very many links is split by the adaptive skew join. Every round is written to the shared folder;
    the rounds end when the links stay the same, after about log(nodes) rounds. Null ends and links of a node
    with itself are ignored; no links give an empty table.
    """
    edges = settle(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .distinct()
    )
    before = _fingerprint(edges)
    while before[0]:
        both = edges.union(edges.select("low", "high")).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        large = (
            both.join(least, "node")
            .where("other > node")
            .select(F.col("other").alias("node"), F.col("least").alias("other"))
            .distinct()
        )
        least = large.groupBy("node").agg(F.min("other").alias("least"))
        hung = large.join(least, "node").where("other != least").select(F.col("other").alias("high"), F.col("least").alias("low"))
        edges = settle(hung.union(least).distinct())
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        edges.select(F.col("low"), F.col("low")).distinct()
    )
