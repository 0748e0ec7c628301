"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.workspace import stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
    return row[0], row[1]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (src, dst): one row (node, root) per node that has an edge, root the least node.

    Alternates large-star and small-star rounds. A round is groupings with map-side minima and joins, so a node with very
    many links is pre-aggregated on one side and may be split by AQE on the other. Each round is written to the shared
    folder and read back; a checksum of the edges tells the last one. Nulls and loops make no edge; no edges, no rows.
    """
    hi, lo = F.greatest("src", "dst"), F.least("src", "dst")
    now = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(hi.alias("hi"), lo.alias("lo"))
    now = stage(now.distinct(), label)
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = stage(least, label)  # a join on top of its own grouping can't be split
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stage(large, label)
        root = stage(large.groupBy("hi").agg(F.min("lo").alias("m")), label)
        small = large.join(root, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = stage(small.unionAll(root.select("hi", F.col("m").alias("lo"))).distinct(), label)
        before, mark = mark, _mark(now)
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
