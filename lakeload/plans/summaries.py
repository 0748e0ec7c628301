"""Maxima per group that are kept up to date: one partial result for each run, merged when they are asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lakeload.functions.audit import RUN_KEYS
from lakeload.sinks.lake import run_folder, snapshot_overwrite

PARTIALS = "_partials"


def _maxima(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(*(F.max(c).alias(c) for c in columns))


def keep_partial(
    rows: DataFrame, group: Sequence[str], columns: Sequence[str], path: str, run_time: str, source_database: str
) -> None:
    """Keep one run's maxima beside the table at ``path``; a repeated run replaces its own.

    Only the group and the columns of this run are read. Maxima are mergeable, so no other run is looked at.
    """
    snapshot_overwrite(_maxima(rows, group, columns), run_folder(f"{path}/{PARTIALS}", run_time, source_database))


def merged_maxima(
    spark: SparkSession, path: str, schema: StructType, group: Sequence[str], columns: Sequence[str],
    runs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """The maxima over ``runs`` (source database, run time), by default all, from their partial results alone.

    ``schema`` is that of the table; null groups are one group, and a maximum over nulls is null, as in the full
    aggregate. Without a run there is no row.
    """
    kept = StructType([schema[c] for c in (*group, *columns)])
    if runs is None:
        read = StructType(kept.fields)
        for key in RUN_KEYS:
            read = read.add(key, StringType())
        partials = spark.read.schema(read).parquet(f"{path}/{PARTIALS}")
    elif runs:
        folders = [run_folder(f"{path}/{PARTIALS}", run, source) for source, run in runs]
        partials = spark.read.schema(kept).parquet(*folders)
    else:
        partials = spark.createDataFrame([], kept)
    return _maxima(partials, group, columns)
