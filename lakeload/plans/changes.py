"""Increments that see changes: extracts with an overlap behind a kept bookmark, merged by key when they are read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.functions.audit import INCREMENT
from lakeload.plans.catalog import quoted
from lakeload.plans.export import Reader, Target, export_table
from lakeload.sources.lake import latest_snapshot, rows_of_run

BOOKMARK = "lakeload.bookmark"


def _property(source_database: str, version: str) -> str:
    return f"{BOOKMARK}.{source_database}.{version}"


def bookmark(spark: SparkSession, table: str, version: str, source_database: str) -> Column | None:
    """The highest version that a finished run has loaded, as a literal of the column's type; None before the first."""
    if not spark.catalog.tableExists(table):
        return None
    kept = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    text = kept.get(_property(source_database, version))
    if text is None:
        return None
    kind = spark.table(table).schema[version].dataType
    if isinstance(kind, T.TimestampType):  # kept as a number, for its text depends on the session's time zone
        return F.timestamp_micros(F.lit(int(text)))
    return F.lit(text).cast(kind)


def keep_bookmark(spark: SparkSession, table: str, version: str, target: Target) -> None:
    """Move the bookmark to the highest version of the run just written, never back. Reads one column of that run."""
    rows = rows_of_run(spark, table, target.source_database, target.run_time)
    kept = bookmark(spark, table, version, target.source_database)
    highest = F.max(version) if kept is None else F.greatest(F.max(version), kept)  # ignores nulls
    if isinstance(rows.schema[version].dataType, T.TimestampType):
        highest = F.unix_micros(highest)
    text = rows.agg(highest.cast("string")).first()[0]
    if text is not None:
        name = quoted(_property(target.source_database, version))
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({name} = {quoted(text)})")


def export_changes(
    spark: SparkSession, read: Reader, table: str, version: str, overlap: str, target: Target
) -> tuple[str, int, int, str]:
    """As ``export_table``, but only rows whose ``version`` is at most ``overlap`` below the bookmark, or unknown.

    ``version`` is a column that grows with each change of a row, such as a time of change. ``overlap`` is a SQL literal
    that can be taken from it (``INTERVAL 2 DAYS``, ``1000``): rows that turn up late are seen as long as they are not
    later than that. The first run is full. Rows that the overlap loads again do no harm, for ``latest_rows`` keeps one
    of each key. The bookmark moves only when the run is complete, so a failed run is simply repeated. Rows deleted in
    the source stay until the next full run.
    """
    name = f"{target.database}.{table}"
    mark = bookmark(spark, name, version, target.source_database)
    if mark is None:
        done = export_table(spark, read, table, target)
    else:
        target = replace(target, run_time=target.run_time + INCREMENT)
        changed = (F.col(version) >= mark - F.expr(overlap)) | F.col(version).isNull()
        done = export_table(spark, lambda t: read(t).filter(changed), table, target)
    keep_bookmark(spark, name, version, target)
    return done


def latest_rows(spark: SparkSession, table: str, keys: Sequence[str], version: str) -> DataFrame:
    """The present state: of each key of each source the row with the highest version, of equal ones that of the last run.

    Versions that are null are lowest; rows equal in version and run are told apart by their other columns, so reruns
    agree. A null key is a key like any other. Only the last full run and its increments are read. The maximum is
    mergeable: versions of a row meet before the shuffle where one task reads them, and a much changed key is no hot key.
    """
    rows = latest_snapshot(spark, table)
    group = ["source_database", *keys]
    order = [version, "processing_time"]
    rest = [c for c in rows.columns if c not in (*group, *order)]
    names = [c for c in (*order, *rest) if c not in group]
    best = rows.groupBy(*group).agg(F.max(F.struct(*(F.col(f"`{c}`") for c in names))).alias("_best"))
    return best.select(*(F.col(f"`{c}`" if c in group else f"_best.`{c}`") for c in rows.columns))

