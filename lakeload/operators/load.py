"""Loads that can be repeated: insert-ignore, seed, per-table guard, increments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.operators.constraints import all_present
from lakeload.specs import CUSTOMER_SEED, CUSTOMERS
from lakeload.workspace import stage


def number_rows(df: DataFrame, order_by: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Dense consecutive numbers in the order of ``order_by`` without one global window.

    Rows are range-partitioned and sorted, written with their place in the partition, and shifted by the number of rows
    in the partitions before. Only one count per partition passes through the driver.
    """
    spark = df.sparkSession
    placed = (
        stage(df, "unnumbered")
        .repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = stage(placed, "placed")
    partition = F.shiftright("_place", 33)  # documented layout: partition number above 33 bits of row number
    counts = placed.groupBy(partition.alias("partition")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, before = [], start
    for row in sorted(counts, key=lambda r: r["partition"]):
        offsets.append((row["partition"], before))
        before += row["n"]
    offsets = spark.createDataFrame(offsets, "_partition bigint, _offset bigint")
    numbered = placed.withColumn("_partition", partition).join(F.broadcast(offsets), "_partition")
    row_in_partition = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select((F.col("_offset") + row_in_partition).alias(name), *df.columns)


def insert_ignore(
    target: DataFrame, incoming: DataFrame, key: Sequence[str], id_column: str, order_by: Sequence[str]
) -> DataFrame:
    """The rows of ``incoming`` that are new, with the next ids; the caller appends them to ``target``.

    A row is skipped if its key is in ``target`` or occurred earlier in the input. ``order_by`` is the input position, a
    different one for each row. NULL keys never collide. Keys and positions alone are compared: those that ``target``
    holds go first, positions are numbered, and the first number per key is found by a partial hash aggregate, so a much
    repeated key is merged before the shuffle. The winning rows are then fetched by position.
    """
    places = incoming.select(*dict.fromkeys([*key, *order_by]))
    named = places.filter(all_present(key)).join(target.select(*key), list(key), "left_anti")
    named = number_rows(named.select(*places.columns), order_by, "_nth")
    first = named.groupBy(*key).agg(F.min("_nth").alias("_nth"))
    winners = named.join(first, [*key, "_nth"]).select(*order_by)
    winners = winners.unionByName(places.filter(~all_present(key)).select(*order_by))
    highest = target.agg(F.max(id_column)).first()[0] or 0
    numbered = number_rows(winners, order_by, id_column, start=highest + 1)
    rows = incoming.join(numbered, list(order_by))
    return rows.select(id_column, *[c for c in incoming.columns if c not in order_by])


def customer_seed(spark: SparkSession) -> DataFrame:
    """The rows an empty customers table starts with."""
    seed = spark.createDataFrame(CUSTOMER_SEED, "customer_id int, name string, email string, day string")
    return seed.withColumn("day", F.to_date("day")).toDF(*CUSTOMERS.column_names)


def seed_if_empty(target: DataFrame, seed: DataFrame, append: Callable[[DataFrame], None]) -> bool:
    """Append ``seed`` only when ``target`` holds no row; tells whether it did. Reads at most one row."""
    if not target.isEmpty():
        return False
    append(seed)
    return True


def load_if_unpopulated(
    spark: SparkSession, loads: dict[str, tuple[DataFrame | None, Callable[[], None]]]
) -> DataFrame:
    """Run each table's load unless that table (not just some of them) already holds rows.

    ``loads`` maps a table to its present content (None if it does not exist yet) and the action that loads it.
    """
    outcome = []
    for table, (present, load) in loads.items():
        populated = present is not None and not present.isEmpty()
        if not populated:
            load()
        outcome.append((table, "skipped" if populated else "loaded"))
    return spark.createDataFrame(outcome, "table_name string, action string")


def rows_beyond(source: DataFrame, key: str, mark) -> DataFrame:
    """Source rows whose key is above ``mark``, all without one.

    The mark is one value, so it goes into the filter as a literal, which Spark pushes to the database or into Parquet.
    """
    return source if mark is None else source.filter(F.col(key) > F.lit(mark))


def incremental_extract(source: DataFrame, lake: DataFrame | None, key: str) -> DataFrame:
    """Source rows beyond the highest key among ``lake``, best the rows of its last run only."""
    return rows_beyond(source, key, lake.agg(F.max(key)).first()[0] if lake is not None else None)
