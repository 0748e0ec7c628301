"""Which rows differ between two versions of a table, found through a tree of sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeload.functions.checksum import hash_total, row_hash
from lakeload.workspace import stage

#: Bits of a key's hash that each level of the tree adds, and rows of a leaf that are aimed at.
LEVEL_BITS, LEAF_ROWS = 6, 256
MOST_LEVELS = 5


def _bucket(keys: Sequence[str], bits: int) -> Column:
    if not bits:
        return F.lit(0).cast("long")
    return F.shiftrightunsigned(row_hash(keys), 64 - bits)


def _sums(rows: DataFrame, by: Sequence[Column], weights: bool = False) -> DataFrame:
    """Rows and content of each bucket; sums add up, so a node is the sum of its children."""
    if weights:
        return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("content").alias("content"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), hash_total(F.col("_row")).alias("content"))


def hash_leaves(table: DataFrame, keys: Sequence[str], columns: Sequence[str], levels: int) -> DataFrame:
    """(bucket, n, content): the leaves of the tree over ``table``, one scan, summed up by each task before the shuffle.

    They are small and can be kept beside a run, so that a later comparison need not read the run again."""
    hashed = table.select(_bucket(keys, levels * LEVEL_BITS).alias("bucket"), row_hash(columns).alias("_row"))
    return _sums(hashed, [F.col("bucket")])


def differing_leaves(left: DataFrame, right: DataFrame, levels: int) -> DataFrame:
    """(bucket): the leaves whose sums differ. From the root down, only children of nodes that differ are looked at."""

    def nodes(leaves: DataFrame, depth: int, above: DataFrame | None) -> DataFrame:
        part = leaves.withColumn("node", F.shiftright("bucket", (levels - depth) * LEVEL_BITS))
        if above is not None:
            part = part.withColumn("above", F.shiftright("node", LEVEL_BITS)).join(above, "above", "left_semi")
        return _sums(part, [F.col("node")], weights=True)

    differing = None
    for depth in range(levels + 1):
        above = differing.withColumnRenamed("node", "above") if differing is not None else None
        a, b = nodes(left, depth, above).alias("a"), nodes(right, depth, above).alias("b")
        pairs = a.join(b, F.col("a.node") == F.col("b.node"), "full_outer")
        same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.content").eqNullSafe(F.col("b.content"))
        differing = stage(pairs.where(~same).select(F.coalesce("a.node", "b.node").alias("node")), "differing")
        if differing.isEmpty():
            break
    return differing.select(F.col("node").alias("bucket"))


def differing_rows(source: DataFrame, lake: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys at which ``lake`` differs from ``source``, with ``difference`` and the ``columns`` that differ.

    difference: ``lost`` (not in the lake), ``added`` (not in the source), ``changed`` (other values), ``copies`` (other
    counts of rows). Compared on the source's columns and in their types; columns that the lake lacks count as NULL. NULLs in
    keys are equal. Repeated keys are compared as sets of rows with their counts.

    Each side is scanned once for its leaves and, if any differ, once more for the rows of those leaves, of which no more
    than those are shuffled. Leaves hold some hundred rows whatever the size of the table.
    """
    kinds = dict(source.dtypes)
    alike = lake.select(
        *[(F.col(f"`{c}`").try_cast(k) if c in lake.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()]
    )
    rows, levels = source.count(), 1
    while levels < MOST_LEVELS and rows > LEAF_ROWS << (levels * LEVEL_BITS):
        levels += 1
    sides = {"source": source.select(*kinds), "lake": alike}
    leaves = {name: stage(hash_leaves(side, keys, list(kinds), levels), f"leaves-{name}") for name, side in sides.items()}
    differing = differing_leaves(leaves["source"], leaves["lake"], levels)
    bucket = _bucket(keys, levels * LEVEL_BITS)
    met = [
        side.withColumn("_bucket", bucket).withColumn("_side", F.lit(name)).join(
            differing.select(F.col("bucket").alias("_bucket")), "_bucket", "left_semi"
        )
        for name, side in sides.items()
    ]

    def sums(side: str) -> list[Column]:
        here = F.col("_side") == side
        contents = [F.when(here, row_hash([c])) for c in kinds]
        totals = [hash_total(c).alias(f"{side}_{n}") for n, c in enumerate(contents)]
        whole = hash_total(F.when(here, row_hash(list(kinds)))).alias(f"{side}_content")
        return [F.count(F.when(here, 1)).alias(f"{side}_rows"), whole, *totals]

    compared = reduce(DataFrame.union, met).groupBy(*keys).agg(*sums("source"), *sums("lake"))
    named = [F.when(F.col(f"source_{n}") != F.col(f"lake_{n}"), F.lit(c)) for n, c in enumerate(kinds)]
    difference = (
        F.when(F.col("lake_rows") == 0, "lost")
        .when(F.col("source_rows") == 0, "added")
        .when(F.col("source_rows") != F.col("lake_rows"), "copies")
        .when(F.col("source_content") != F.col("lake_content"), "changed")
    )
    told = compared.withColumn("difference", difference).where("difference IS NOT NULL")
    columns = F.when(F.col("difference") == "changed", F.array_join(F.array_compact(F.array(*named)), ","))
    return told.select(*keys, "difference", columns.alias("columns"))
