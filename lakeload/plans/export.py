"""Export of many tables: extract, stamp, write, catalog, check - one failing table does not stop the others."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial
from threading import Event, Timer

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from lakeload.functions.audit import INCREMENT, audit_columns
from lakeload.operators.load import rows_beyond
from lakeload.plans.catalog import (
    SchemaChanged,
    add_run,
    create_database,
    external_table,
    fit_to_table,
    quoted,
    schema_evolution,
)
from lakeload.plans.reports import check_run
from lakeload.sinks.lake import empty_marker, run_folder, snapshot_append, write_with_metrics
from lakeload.sinks.manifest import MANIFEST_OF, Run, commit, manifest
from lakeload.sources.lake import all_runs, increment_mark

log = logging.getLogger(__name__)
Reader = Callable[[str], DataFrame]
SUMMARY = "table_name string, status string, rows_read bigint, rows_written bigint, changes string, error string"


@dataclass(frozen=True)
class Target:
    """Where one run writes: lake folder, catalog database, and the run's label and origin."""

    root: str
    database: str
    run_time: str
    source_database: str


class CheckFailed(Exception):
    """What the run wrote can't be read back as it was written."""


def _relative(run_time: str, source_database: str) -> str:
    return run_folder("", run_time, source_database).lstrip("/")


def _commit(spark: SparkSession, name: str, location: str, runs: Sequence[Run]) -> None:
    if commit(spark, location, runs) == 1:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({quoted(MANIFEST_OF)} = {quoted(location)})")


def _take_back(spark: SparkSession, name: str, location: str, target: Target) -> None:
    """Before a run is written (again): it is no committed run until it is complete.

    Runs of a table that has no manifest yet are taken to be complete; their rows are not counted for it (-1).
    """
    version, runs = manifest(spark, location)
    this = (target.run_time, target.source_database)
    if version == 0:
        schema = spark.table(name).schema.json()
        found = [(run, source) for source, run in all_runs(spark, name) if (run, source) != this]
        _commit(spark, name, location, [Run(*r, "", _relative(*r), -1, schema) for r in found])
    elif this in {(run.run_time, run.source_database) for run in runs}:
        commit(spark, location, [], [this])


def export_table(spark: SparkSession, read: Reader, table: str, target: Target) -> tuple[str, int, int, str]:
    """One table to the lake and the catalog: its status, rows read, rows found by the check, and changes of its schema.

    The source is read once. Its schema is compared with the table's before anything is written; what was written is
    counted through the catalog afterwards (``post_export_check`` reads every column), and a difference fails the table.
    A run is committed last: until then, and after a failure, ``latest_snapshot`` doesn't know it.
    """
    source, changes = read(table), ""
    location, name = f"{target.root}/{table}", f"{target.database}.{table}"
    run = (target.run_time, target.source_database)
    if spark.catalog.tableExists(name):
        stamped = audit_columns(source, *run, table)
        fitted, changes = fit_to_table(spark, name, stamped)
        source = fitted.select(*source.columns)
        _take_back(spark, name, location, target)
    schema = audit_columns(source, *run, table).schema
    write = partial(
        snapshot_append, path=location, run_time=run[0], source_database=run[1], source_table=table
    )
    rows = write_with_metrics(source, write)
    external_table(spark, name, schema, location)
    schema_evolution(spark, name, schema)
    add_run(spark, name, *run)
    if rows == 0:
        empty_marker(spark, source.schema, target.root, table, *run)
    found = check_run(spark, name, *run, False)
    if found != rows:
        raise CheckFailed(f"{rows} rows written, {found} found")
    _commit(spark, name, location, [Run(*run, table, _relative(*run), rows, schema.json())])
    return "ok" if rows else "empty", rows, found, changes


def export_increment(
    spark: SparkSession, read: Reader, table: str, key: str, target: Target
) -> tuple[str, int, int, str]:
    """As ``export_table``, but only rows whose key is above all loaded before, as a run marked as an increment.

    A table without a run gets a full one. Rows that come late with a lower key, and changes of rows already loaded, are
    not seen: they need a full run, which the latest state then starts from.
    """
    name = f"{target.database}.{table}"
    mark = None
    if spark.catalog.tableExists(name):
        mark = increment_mark(spark, name, key, target.source_database)
    if mark is None:
        return export_table(spark, read, table, target)
    later = replace(target, run_time=target.run_time + INCREMENT)
    return export_table(spark, lambda name: rows_beyond(read(name), key, mark), table, later)


def error_kind(error: Exception) -> str:
    """What went wrong without its text, which may hold connection details."""
    if isinstance(error, Py4JJavaError):
        return error.java_exception.getClass().getName()
    if isinstance(error, PySparkException) and error.getCondition():
        return error.getCondition()
    return type(error).__name__


def _within_limit(
    spark: SparkSession, read: Reader, table: str, key: str | None, target: Target, max_attempts: int, limit: float | None
) -> tuple:
    """``_attempt`` in a scheduler pool named as the table; its Spark jobs are cancelled when its time is up."""
    context, tag, late = spark.sparkContext, f"lakeload-{uuid.uuid4().hex}", Event()

    def stop():
        late.set()
        context.cancelJobsWithTag(tag)

    timer = Timer(limit, stop) if limit else None
    pool = context.getLocalProperty("spark.scheduler.pool")
    context.setLocalProperty("spark.scheduler.pool", table)
    context.addJobTag(tag)
    try:
        if timer:
            timer.daemon = True
            timer.start()
        return _attempt(spark, read, table, key, target, max_attempts, late)
    finally:
        if timer:
            timer.cancel()
        context.removeJobTag(tag)
        context.setLocalProperty("spark.scheduler.pool", pool)


def _attempt(
    spark: SparkSession, read: Reader, table: str, key: str | None, target: Target, max_attempts: int, late: Event
) -> tuple:
    for attempt in range(1, max_attempts + 1):
        try:
            if key:
                return (table, *export_increment(spark, read, table, key, target), None)
            return (table, *export_table(spark, read, table, target), None)
        except Exception as error:  # any failure belongs in the summary and must not stop the other tables
            kind = "timeout" if late.is_set() else error_kind(error)
            log.warning("export of %s failed (%s), attempt %d of %d", table, kind, attempt, max_attempts)
            if late.is_set() or isinstance(error, SchemaChanged):  # trying again would not help
                break
            if attempt < max_attempts:
                time.sleep(2 ** (attempt - 1))
    return (table, "failed", None, None, None, kind)


def export_tables(
    spark: SparkSession,
    read: Reader,
    tables: Sequence[str],
    target: Target,
    max_attempts: int = 3,
    parallelism: int = 4,
    increments: dict[str, str] | None = None,
    limits: dict[str, float] | None = None,
) -> DataFrame:
    """Export every table and report (table_name, status, rows_read, rows_written, changes, error), one row each.

    ``rows_written`` is what a query of the catalog finds of this run; ``changes`` are those of the schema since the runs
    before. A changed type that the table can't hold fails the table and writes nothing.

    ``read`` gives a table as a DataFrame, e.g. ``partial(jdbc_scan, spark, source)``. Threads only submit Spark jobs.
    Repeating a failed attempt is safe: a run replaces its own partition. ``increments`` names the growing key of tables
    of which only new rows are wanted.

    ``limits`` are seconds that a table may take with all its attempts: then its Spark jobs are cancelled, it is failed
    with the error ``timeout``, and the others go on. What happens outside Spark jobs, such as connecting, is not
    interrupted. Each table's jobs run in a scheduler pool of its name, so with ``spark.scheduler.mode`` FAIR a large one
    does not keep the small ones waiting.
    """
    create_database(spark, target.database, f"{target.root}/_database")
    with ThreadPoolExecutor(parallelism) as pool:
        work = inheritable_thread_target(spark)(_within_limit)
        keys, seconds = increments or {}, limits or {}
        outcome = list(
            pool.map(lambda t: work(spark, read, t, keys.get(t), target, max_attempts, seconds.get(t)), tables)
        )
    return spark.createDataFrame(outcome, SUMMARY)


def failed(summary: DataFrame) -> bool:
    """Whether any table failed, for the exit code of a job."""
    return not summary.filter("status = 'failed'").isEmpty()
