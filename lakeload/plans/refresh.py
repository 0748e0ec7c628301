"""Loading a whole database: from dump files with quarantine, and as a full refresh."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.operators.quarantine import batch_summary, quarantine
from lakeload.plans.catalog import create_database, external_table
from lakeload.plans.export import error_kind
from lakeload.plans.reports import table_counts
from lakeload.sinks.lake import snapshot_overwrite
from lakeload.sources.dump import dump_format_check, dump_scan
from lakeload.specs import TableSpec, load_order

log = logging.getLogger(__name__)
LOADED = (
    "table_name string, batches bigint, loaded bigint, refused bigint, status string, format string, error string, "
    "earlier string"
)
STATUS = "lakeload.status"


def drop_all(spark: SparkSession, specs: Sequence[TableSpec], database: str) -> None:
    """Drop all views of the database, then the tables, children first. The files of external tables stay."""
    for view in spark.sql(f"SHOW VIEWS IN {database}").filter("NOT isTemporary").collect():
        spark.sql(f"DROP VIEW IF EXISTS {database}.`{view['viewName']}`")
    for spec in reversed(load_order(specs)):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{spec.name}")


def _fresh_folder(root: str, table: str) -> str:
    """A folder of its own for each load, so that the present rows stay until the new ones are complete."""
    return f"{root}/{table}/{uuid.uuid4().hex}"


def _formats(spark: SparkSession, parts: Sequence[str]) -> str:
    """What is wrong with the dump files, ``ok`` if nothing."""
    found = dump_format_check(spark, parts).select("status").distinct().collect()
    return ",".join(sorted(r["status"] for r in found if r["status"] != "ok")) or "ok"


def load_dumps(
    spark: SparkSession,
    specs: Sequence[TableSpec],
    dumps: dict[str, Sequence[str]],
    root: str,
    database: str,
    whole_files: Sequence[str] = (),
    refresh: bool = False,
    views: Callable[[SparkSession, str], None] | None = None,
) -> DataFrame:
    """Load each table's dump files into external tables, parents first; one row per table tells what came of it.

    Refused batches go to ``<root>/_rejected/<table>`` with their reasons and, for rows that could not be read, the
    source text; each load replaces those of the load before. Tables named in ``whole_files`` load or fail by the file, the others by the statement.

    ``status`` is loaded, partial, failed or skipped. A table that holds rows is skipped unless ``refresh``, and
    ``earlier`` then tells how its load ended. ``format`` tells files that end within a statement (``unterminated``) or
    hold none (``unexpected_format``). A table whose load fails with an ``error`` (an absent file, say) keeps the rows
    it has, normally none; the others go on, and rows that refer to it find no parent.
    """
    create_database(spark, database, f"{root}/_database")
    loaded, summary, fresh = {}, [], {}
    for spec in load_order(specs):
        name = f"{database}.{spec.name}"
        there = spark.catalog.tableExists(name)
        loaded[spec.name] = spark.table(name) if there else spark.createDataFrame([], spec.schema)
        if there and not refresh and not loaded[spec.name].isEmpty():
            earlier = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
            summary.append((spec.name, None, None, None, "skipped", None, None, earlier.get(STATUS)))
            continue
        try:
            fmt = _formats(spark, dumps[spec.name])
            rows = dump_scan(spark, dumps[spec.name], spec, "file" if spec.name in whole_files else "statement")
            parents = {n: df for n, df in loaded.items() if n != spec.name}
            split = quarantine(rows, spec, parents=parents, unchecked=[spec.name])
            location = _fresh_folder(root, spec.name)
            snapshot_overwrite(split.good.select(*spec.column_names), location)
            snapshot_overwrite(split.bad, f"{root}/_rejected/{spec.name}")  # no rows too: those refused earlier go
            counts = batch_summary(spec.name, rows, split.rejected).first()
        except Exception as error:  # a table that fails must not stop the others
            kind = error_kind(error)
            log.warning("load of %s failed (%s)", spec.name, kind)
            summary.append((spec.name, 0, 0, 0, "failed", None, kind, None))
            continue
        fresh[spec.name] = (location, counts["status"])
        loaded[spec.name] = spark.read.schema(spec.schema).parquet(location)
        summary.append((*counts, fmt, None, None))
    for spec in load_order(specs):
        if spec.name in fresh:
            name, (location, status) = f"{database}.{spec.name}", fresh[spec.name]
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            external_table(spark, name, spec.schema, location, partitions=())
            spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{STATUS}' = '{status}')")
    if views:
        views(spark, database)
    return spark.createDataFrame(summary, LOADED)


def complete(summary: DataFrame) -> bool:
    """Whether every table of a load is whole, for the exit code of a job: a skipped one if its load was."""
    ended = F.when(F.col("status") == "skipped", F.col("earlier")).otherwise(F.col("status"))
    whole = (F.coalesce(ended, F.lit("")) == "loaded") & (F.coalesce("format", F.lit("ok")) == "ok")
    return summary.filter(~whole).isEmpty()


def full_refresh(
    spark: SparkSession,
    specs: Sequence[TableSpec],
    read: Callable[[str], DataFrame],
    root: str,
    database: str,
    views: Callable[[SparkSession, str], None] | None = None,
) -> DataFrame:
    """Reload every table, parents first, then drop views and old tables, recreate both, and count.

    Everything is written to new folders before anything is dropped: a failure leaves the database as it was. ``read``
    may read from the tables being replaced. The folders replaced are left to their owner.
    """
    create_database(spark, database, f"{root}/_database")
    ordered = load_order(specs)
    locations = {spec.name: _fresh_folder(root, spec.name) for spec in ordered}
    for spec in ordered:
        snapshot_overwrite(read(spec.name).select(*spec.column_names), locations[spec.name])
    drop_all(spark, ordered, database)
    for spec in ordered:
        external_table(spark, f"{database}.{spec.name}", spec.schema, locations[spec.name], partitions=())
    if views:
        views(spark, database)
    return table_counts({spec.name: spark.table(f"{database}.{spec.name}") for spec in ordered})
