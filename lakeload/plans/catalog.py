"""External tables over lake folders, their partitions, and the growth of their schema."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeload.functions.audit import RUN_KEYS

CHANGES = "column_name string, change string, table_type string, file_type string"


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_database(spark: SparkSession, name: str, location: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION {quoted(location)}")


def external_table(
    spark: SparkSession, table: str, schema: StructType, location: str, partitions: Sequence[str] = RUN_KEYS
) -> None:
    """Declare a Parquet folder as a table. Every partition key of the folder must be declared, or repair finds none.

    ``schema`` holds the data columns; partition keys in it are declared last, as text.
    """
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name not in partitions]
    columns += [f"`{p}` STRING" for p in partitions]
    by = f"PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(columns)}) USING parquet {by} LOCATION {quoted(location)}"
    )


def partition_repair(spark: SparkSession, table: str) -> None:
    """Register every partition folder found on disk."""
    spark.sql(f"MSCK REPAIR TABLE {table}")


def add_run(spark: SparkSession, table: str, run_time: str, source_database: str) -> None:
    """Register the one folder a run wrote, without listing the table."""
    spark.sql(
        f"ALTER TABLE {table} ADD IF NOT EXISTS "
        f"PARTITION (processing_time = {quoted(run_time)}, source_database = {quoted(source_database)})"
    )
    spark.catalog.refreshTable(table)


def file_schema(spark: SparkSession, path: str) -> StructType:
    """The schema of all Parquet files under ``path``, merged; the files are read for it as a Spark job."""
    return spark.read.option("mergeSchema", True).parquet(path).schema


def _changes(spark: SparkSession, table: str, schema: StructType) -> list[tuple[str, str, str | None, str | None]]:
    def types(declared: StructType) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in declared.fields if f.name not in RUN_KEYS}

    in_table, in_files = types(spark.table(table).schema), types(schema)
    changes = []
    for name in sorted(in_files | in_table):
        old, new = in_table.get(name), in_files.get(name)
        if old != new:
            change = "added" if old is None else "removed" if new is None else "type_changed"
            changes.append((name, change, old, new))
    return changes


# Types of a new snapshot that a column of the table holds without loss, by the table's type.
WIDENS = {
    "smallint": ("tinyint",),
    "int": ("tinyint", "smallint"),
    "bigint": ("tinyint", "smallint", "int"),
    "double": ("float", "tinyint", "smallint", "int"),
    "float": ("tinyint", "smallint"),
}


def _holds(wide: str, narrow: str) -> bool:
    if narrow in WIDENS.get(wide, ()):
        return True
    sizes = [re.fullmatch(r"decimal\((\d+),(\d+)\)", kind) for kind in (wide, narrow)]
    if not all(sizes):
        return False
    (p, s), (q, t) = ([int(n) for n in size.groups()] for size in sizes)
    return s >= t and p - s >= q - t


class SchemaChanged(Exception):
    """A column's type can't be held by the table: writing it would make the table's history unreadable."""


def fit_to_table(spark: SparkSession, table: str, df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with columns cast to the types of ``table`` where that loses nothing, and the changes in short.

    To be called before anything is written. Raises if a column can't be held.
    """
    told, casts = [], {}
    for name, change, old, new in _changes(spark, table, df.schema):
        if change == "type_changed":
            if not _holds(old, new):
                raise SchemaChanged(f"{name} is {new}, the table has {old}")
            casts[name], change = F.col(f"`{name}`").cast(old), "widened"
        told.append(f"{change}:{name}")
    return df.withColumns(casts) if casts else df, ",".join(told)


def schema_diff(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The columns of a new snapshot against those of the table: added, removed, type_changed."""
    return spark.createDataFrame(_changes(spark, table, schema), CHANGES)


def schema_evolution(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """Add the columns that are new in ``schema`` to the table and return the full report.

    Columns that are gone or changed type are reported only: earlier snapshots still hold them.
    """
    changes = _changes(spark, table, schema)
    new = ", ".join(f"`{name}` {new_type}" for name, change, _, new_type in changes if change == "added")
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({new})")
    return spark.createDataFrame(changes, CHANGES)
