"""The two jobs, for ``python -m lakeload`` or, through ``job.py``, for spark-submit.

    export      every table of a database (or those named) to the lake and the catalog
    load-dumps  the employee database from SQL dump files, with quarantine

How to reach the database comes from Spark settings named ``spark.lakeload.jdbc.*`` (url, user, password, driver ...),
best from a properties file, so that no secret is an argument; Spark redacts the password in its own logs.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lakeload.functions.audit import run_time_label
from lakeload.plans.export import Target, export_tables, failed
from lakeload.plans.refresh import complete, load_dumps
from lakeload.plans.reports import table_counts
from lakeload.plans.views import create_views, sample_join
from lakeload.sources.jdbc import JdbcSource, jdbc_reader, primary_keys, source_table_list
from lakeload.specs import EMPLOYEE_DATABASE

JDBC = "spark.lakeload.jdbc."


def jdbc_source(spark: SparkSession) -> JdbcSource:
    settings = {k.removeprefix(JDBC): v for k, v in spark.conf.getAll.items() if k.startswith(JDBC)}
    return JdbcSource(settings.pop("url"), settings)


def export(spark: SparkSession, args: argparse.Namespace) -> bool:
    source = jdbc_source(spark)
    listed = source_table_list(spark, source, args.tables or None, args.exclude, args.strip_prefix).collect()
    absent = [r["wanted"] for r in listed if r["resolved"] is None]
    tables = [r["resolved"] for r in listed if r["resolved"] is not None]
    target = Target(args.root, args.database, run_time_label(), args.source_database)
    keys = {} if source.url.startswith("jdbc:derby:") else primary_keys(spark, source)
    keys |= dict(pair.split("=", 1) for pair in args.keys)
    read = jdbc_reader(spark, source, keys, args.partitions, exact=True)
    increments = dict(pair.split("=", 1) for pair in args.increments)
    summary = export_tables(spark, read, tables, target, args.max_attempts, increments=increments)
    summary.show(len(tables), truncate=False)
    if absent:
        print("not found at the source:", ", ".join(absent))
    return bool(tables) and not absent and not failed(summary)


def load(spark: SparkSession, args: argparse.Namespace) -> bool:
    parts = {spec.name: [f"{args.dumps}/load_{spec.name}.dump"] for spec in EMPLOYEE_DATABASE}
    parts["salaries"] = [f"{args.dumps}/load_salaries{i}.dump" for i in (1, 2, 3)]
    whole = ("departments", "dept_manager")
    summary = load_dumps(spark, EMPLOYEE_DATABASE, parts, args.root, args.database, whole, args.refresh)
    summary.show(truncate=False)
    names = [s.name for s in EMPLOYEE_DATABASE if spark.catalog.tableExists(f"{args.database}.{s.name}")]
    tables = {name: spark.table(f"{args.database}.{name}") for name in names}
    if tables:
        table_counts(tables).show(truncate=False)
    if "dept_emp" in tables:
        create_views(spark, args.database)
    if {"employees", "dept_emp", "departments", "titles"} <= set(tables):
        sample_join(tables["employees"], tables["dept_emp"], tables["departments"], tables["titles"], n=5).show()
    return complete(summary)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lakeload")
    jobs = parser.add_subparsers(required=True)
    one = jobs.add_parser("export")
    one.set_defaults(run=export)
    one.add_argument("--source-database", required=True)
    one.add_argument("--tables", nargs="*", default=[])
    one.add_argument("--exclude", nargs="*", default=[])
    one.add_argument("--strip-prefix", default="")
    one.add_argument("--keys", nargs="*", default=[], metavar="TABLE=COLUMN", help="integer keys to read in parallel, besides primary keys")
    one.add_argument("--increments", nargs="*", default=[], metavar="TABLE=KEY", help="export only rows with a new key")
    one.add_argument("--partitions", type=int, default=16)
    one.add_argument("--max-attempts", type=int, default=3)
    two = jobs.add_parser("load-dumps")
    two.set_defaults(run=load)
    two.add_argument("--dumps", required=True)
    two.add_argument("--refresh", action="store_true", help="reload tables that already hold rows")
    for job in (one, two):
        job.add_argument("--root", required=True)
        job.add_argument("--database", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lakeload").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return 0 if args.run(spark, args) else 1


if __name__ == "__main__":
    sys.exit(main())
