"""Parquet sinks: run-partitioned snapshots, replaced snapshots, markers for empty tables, counts taken while writing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeload.functions.audit import RUN_KEYS, audit_columns

MARKERS = "_empty_markers"


# Characters that a partition folder's name holds escaped, besides the control characters.
ESCAPED = "\"#%'*/:=?\\{[]^\x7f"


def _escape(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in value)


def run_folder(path: str, run_time: str, source_database: str) -> str:
    """The folder that holds one run's partition of the table at ``path``."""
    folders = (f"{key}={_escape(value)}" for key, value in zip(RUN_KEYS, (run_time, source_database), strict=True))
    return "/".join([path, *folders])


def snapshot_append(df: DataFrame, path: str, run_time: str, source_database: str, source_table: str) -> None:
    """Add the rows of one run to the table at ``path``, stamped with run and origin.

    They go straight to the run's own folder, which is replaced as a whole, so a repeated or resumed run leaves one copy,
    not two, the snapshots of other runs stay, and no file is renamed between folders. No rows make an empty snapshot.
    """
    stamped = audit_columns(df, run_time, source_database, source_table)
    snapshot_overwrite(stamped.drop(*RUN_KEYS), run_folder(path, run_time, source_database))


def snapshot_overwrite(df: DataFrame, path: str) -> None:
    """Replace the table's folder with ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_with_metrics(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write and return the number of rows written, in one pass over the source."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def marker_path(root: str, table: str) -> str:
    """Beside the tables, not inside one, so that no table scan meets a marker."""
    return f"{root}/{MARKERS}/{table}"


def empty_marker(
    spark: SparkSession, schema: StructType, root: str, table: str, run_time: str, source_database: str
) -> str:
    """Record that ``table`` was extracted and had no rows: a file with its schema and none. Returns the path."""
    none = audit_columns(spark.createDataFrame([], schema), run_time, source_database, table)
    path = marker_path(root, table)
    snapshot_overwrite(none.withColumn("is_empty_marker", F.lit(True)), path)
    return path
