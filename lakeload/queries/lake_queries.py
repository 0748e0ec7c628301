"""Lake sinks, catalog tables, schema changes, refresh and reports."""

from __future__ import annotations

from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.audit import RUN_KEYS, audit_columns
from lakeload.operators.difference import differing_rows
from lakeload.operators.known_keys import keep_key_filter, known_keys
from lakeload.operators.load import load_if_unpopulated, seed_if_empty
from lakeload.plans.bucketed import bucketed_assignment, bucketed_sample_join, bucketed_table
from lakeload.plans.catalog import create_database, external_table, file_schema, partition_repair, schema_diff, schema_evolution
from lakeload.plans.changes import export_changes, latest_rows
from lakeload.plans.export import Target, export_tables
from lakeload.plans.refresh import full_refresh
from lakeload.plans.reports import post_export_check, reconcile, run_rows, table_counts
from lakeload.plans.summaries import keep_partial, merged_maxima
from lakeload.queries import check_queries
from lakeload.queries.check_queries import interval_tables
from lakeload.queries.inputs import ASSIGNMENTS_SQL, RUN_1, RUN_2, RUN_3, SOURCE, assignments, fresh_database, spec_of, table
from lakeload.sinks.lake import empty_marker, marker_path, snapshot_append, snapshot_overwrite, write_with_metrics
from lakeload.sinks.manifest import commit, commit_run, write_run
from lakeload.sources.committed import committed_history, committed_snapshot
from lakeload.sources.lake import lake_scan, latest_snapshot, sample_rows
from lakeload.workspace import new_folder

EXPORTED = ("customer", "supplier", "part", "orders", "nation")
ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _two_runs(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Orders in two snapshots: all of them, then the finished ones."""
    orders = table(spark, sf, "orders")
    path = new_folder(spark, "snapshots") + "/orders"
    snapshot_append(orders, path, RUN_1, SOURCE, "orders")
    snapshot_append(orders.filter("o_orderstatus = 'F'"), path, RUN_2, SOURCE, "orders")
    return path, orders


def _two_run_table(spark: SparkSession, sf: str) -> str:
    path, orders = _two_runs(spark, sf)
    name = fresh_database(spark, path) + ".orders"
    external_table(spark, name, audit_columns(orders, RUN_1, SOURCE, "orders").schema, path)
    partition_repair(spark, name)
    return name


def q_snapshot_append(spark: SparkSession, sf: str) -> DataFrame:
    path, _ = _two_runs(spark, sf)
    return spark.read.parquet(path).groupBy(*RUN_KEYS, "source_table").agg(F.count(F.lit(1)).alias("row_count"))


def q_external_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.table(_two_run_table(spark, sf))
    return rows.groupBy("processing_time", "o_orderstatus").agg(F.count(F.lit(1)).alias("row_count"))


def q_partition_repair(spark: SparkSession, sf: str) -> DataFrame:
    path, orders = _two_runs(spark, sf)
    name = fresh_database(spark, path) + ".orders"
    external_table(spark, name, audit_columns(orders, RUN_1, SOURCE, "orders").schema, path)
    before = spark.table(name).count()
    partition_repair(spark, name)
    per_run = spark.table(name).groupBy("processing_time").agg(F.count(F.lit(1)).alias("row_count"))
    return per_run.withColumn("rows_before", F.lit(before))


def q_lake_scan(spark: SparkSession, sf: str) -> DataFrame:
    return lake_scan(spark, _two_run_table(spark, sf))


def q_latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return latest_snapshot(spark, _two_run_table(spark, sf)).drop(*RUN_KEYS, "source_table")


def q_snapshot_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    path = new_folder(spark, "overwrite")
    snapshot_overwrite(orders, path)
    snapshot_overwrite(orders.filter("o_orderstatus = 'F'"), path)
    return spark.read.parquet(path)


def q_empty_marker(spark: SparkSession, sf: str) -> DataFrame:
    root = new_folder(spark, "marked")
    none = table(spark, sf, "customer").filter("c_acctbal > 1e12")
    write = partial(
        snapshot_append, path=f"{root}/customer", run_time=RUN_1, source_database=SOURCE, source_table="customer"
    )
    rows = write_with_metrics(none, write)
    if rows == 0:
        empty_marker(spark, none.schema, root, "customer", RUN_1, SOURCE)
    marker = spark.read.parquet(marker_path(root, "customer"))
    columns = spark.createDataFrame(marker.dtypes, "column_name string, type string")
    counted = marker.agg(F.count(F.lit(1)).alias("row_count"))
    return columns.withColumn("row_count", F.lit(counted.first()["row_count"]))


def q_write_with_metrics(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "metrics")
    written = [
        (name, write_with_metrics(table(spark, sf, name), partial(snapshot_overwrite, path=f"{folder}/{name}")))
        for name in ("customer", "orders", "lineitem", "documents")
    ]
    return spark.createDataFrame(written, "table_name string, row_count bigint")


def q_audit_columns(spark: SparkSession, sf: str) -> DataFrame:
    return audit_columns(table(spark, sf, "supplier"), RUN_1, SOURCE, "supplier")


def q_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sample_rows(table(spark, sf, "customer"), 10, order_by=[F.desc("c_acctbal"), "c_custkey"])


def q_table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table_counts({name: table(spark, sf, name) for name in ALL_TABLES})


def _changed_orders(spark: SparkSession, sf: str) -> tuple[str, str]:
    """A table of orders without a priority, and a later snapshot with a priority but without a status."""
    orders = table(spark, sf, "orders")
    path = new_folder(spark, "changed") + "/orders"
    old = audit_columns(orders.drop("o_orderpriority"), RUN_1, SOURCE, "orders")
    snapshot_append(orders.drop("o_orderpriority"), path, RUN_1, SOURCE, "orders")
    snapshot_append(orders.drop("o_orderstatus"), path, RUN_2, SOURCE, "orders")
    name = fresh_database(spark, path) + ".orders"
    external_table(spark, name, old.schema, path)
    return name, f"{path}/processing_time={RUN_2}/source_database={SOURCE}"


def q_schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    name, new_files = _changed_orders(spark, sf)
    return schema_diff(spark, name, file_schema(spark, new_files))


def q_schema_evolution(spark: SparkSession, sf: str) -> DataFrame:
    name, new_files = _changed_orders(spark, sf)
    schema_evolution(spark, name, file_schema(spark, new_files))
    partition_repair(spark, name)
    return spark.table(name).select("processing_time", "o_orderkey", "o_orderstatus", "o_orderpriority")


def q_seed_if_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Seeding with the suppliers a table that has no row, and one that holds customers."""
    seed = table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    customers = table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    root = new_folder(spark, "seeded")
    results = []
    for case, content in (("empty", customers.filter("name IS NULL")), ("full", customers)):
        path = f"{root}/{case}"
        snapshot_overwrite(content, path)
        seeded = seed_if_empty(
            spark.read.parquet(path), seed, lambda rows, path=path: rows.write.mode("append").parquet(path)
        )
        after = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"))
        results.append(after.select(F.lit(case).alias("target"), F.lit(seeded).alias("seeded"), "row_count"))
    return reduce(DataFrame.union, results)


def q_load_if_unpopulated(spark: SparkSession, sf: str) -> DataFrame:
    """Customers are there already (those in debt only), orders are not."""
    root = new_folder(spark, "guarded")
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    snapshot_overwrite(customer.filter("c_acctbal < 0"), f"{root}/customer")
    present = spark.read.parquet(f"{root}/customer")
    actions = load_if_unpopulated(
        spark,
        {
            "customer": (present, lambda: snapshot_overwrite(customer, f"{root}/customer")),
            "orders": (None, lambda: snapshot_overwrite(orders, f"{root}/orders")),
        },
    )
    counts = table_counts({name: spark.read.parquet(f"{root}/{name}") for name in ("customer", "orders")})
    return actions.join(counts, "table_name")


def q_full_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """A refresh of a database that already holds a first load."""
    tables = {name: table(spark, sf, name) for name in ("customer", "orders")}
    specs = [spec_of(df, name) for name, df in tables.items()]
    root = new_folder(spark, "refreshed")
    database = fresh_database(spark, root)
    earlier = {
        "customer": tables["customer"].filter("c_acctbal < 0"),
        "orders": tables["orders"].filter("o_orderstatus = 'F'"),
    }
    full_refresh(spark, specs, earlier.__getitem__, root, database)
    return full_refresh(spark, specs, tables.__getitem__, root, database)


def _target(spark: SparkSession, run: str = RUN_1) -> Target:
    folder = new_folder(spark, "export")
    return Target(folder, f"lakeload_{folder[-32:]}", run, SOURCE)


def _export(spark: SparkSession, sf: str, names, target: Target, changed: dict | None = None) -> DataFrame:
    def read(name: str) -> DataFrame:
        return (changed or {}).get(name, lambda df: df)(table(spark, sf, name))

    return export_tables(spark, read, names, target, max_attempts=1)


def _unreadable(df: DataFrame) -> DataFrame:
    raise OSError("the source went away")


def q_export_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A second run: a key of suppliers became text, the sizes of parts a smaller type, and nations lost a column."""
    target = _target(spark)
    _export(spark, sf, EXPORTED, target)
    changed = {
        "supplier": lambda df: df.withColumn("s_nationkey", F.col("s_nationkey").cast("string")),
        "part": lambda df: df.withColumn("p_size", F.col("p_size").cast("smallint")),
        "nation": lambda df: df.drop("n_regionkey"),
        "orders": lambda df: df.withColumn("o_note", F.lit("x")),
    }
    later = replace(target, run_time=RUN_2)
    return _export(spark, sf, (*EXPORTED, "absent"), later, changed)


def q_post_export_check(spark: SparkSession, sf: str) -> DataFrame:
    """After a second run in which one source failed and one was empty; all tables hold the first run too."""
    target = _target(spark)
    _export(spark, sf, EXPORTED, target)
    later = replace(target, run_time=RUN_2)
    _export(spark, sf, EXPORTED, later, {"supplier": _unreadable, "nation": lambda df: df.filter("n_nationkey < 0")})
    return post_export_check(spark, target.database, [*EXPORTED, "absent"], RUN_2, SOURCE)


def q_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """The second of two runs against a source in which every supplier moved, nations went away and orders got a column."""
    target = _target(spark)
    _export(spark, sf, EXPORTED, target, {"customer": lambda df: df.filter("c_acctbal < 0")})
    _export(spark, sf, EXPORTED, replace(target, run_time=RUN_2))
    now = {name: table(spark, sf, name) for name in EXPORTED}
    now["supplier"] = now["supplier"].withColumn("s_nationkey", F.col("s_nationkey") + 1)
    now["nation"] = now["nation"].filter("n_regionkey <> 0")
    now["orders"] = now["orders"].withColumn("o_note", F.lit(None).cast("string"))
    report = reconcile(
        {name: (df, run_rows(spark, f"{target.database}.{name}", RUN_2, SOURCE)) for name, df in now.items()}
    )
    return report.select("table_name", "source_rows", "lake_rows", "missing_columns", "matches")


def q_incremental_job(spark: SparkSession, sf: str) -> DataFrame:
    """A full run of the older orders, two increments, the second without news: the latest state is the source."""
    orders = table(spark, sf, "orders")
    mark = orders.agg((F.max("o_orderkey") * 4).alias("m")).first()["m"] // 5
    target, keys = _target(spark), {"orders": "o_orderkey"}
    export_tables(spark, lambda name: orders.filter(F.col("o_orderkey") <= mark), ["orders"], target, 1)
    for run in (RUN_2, RUN_3):
        later = replace(target, run_time=run)
        export_tables(spark, lambda name: orders, ["orders"], later, 1, increments=keys)
    return latest_snapshot(spark, f"{target.database}.orders").drop("source_table", "source_database")


def q_changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Older orders without some that come late, then all, the finished ones changed: the latest state is the source.

    A third run finds nothing new but what its overlap loads again.
    """
    orders = table(spark, sf, "orders").withColumn("changed_at", F.col("o_orderdate"))
    last = F.lit(orders.agg(F.max("o_orderdate").cast("string")).first()[0]).cast(orders.schema["o_orderdate"].dataType)
    middle = last - F.expr("INTERVAL 1000 DAYS")
    late = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= middle - F.expr("INTERVAL 20 DAYS"))
    finished = F.col("o_orderstatus") == "F"
    changed = orders.withColumns(
        {
            "changed_at": F.when(finished, last + F.expr("INTERVAL 1 DAY")).otherwise(F.col("changed_at")),
            "o_totalprice": F.when(finished, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")),
        }
    )
    target = _target(spark)
    create_database(spark, target.database, f"{target.root}/_database")
    runs = ((RUN_1, orders.filter((F.col("o_orderdate") < middle) & ~late)), (RUN_2, changed), (RUN_3, changed))
    for run, source in runs:
        export_changes(
            spark, lambda _, df=source: df, "orders", "changed_at", "INTERVAL 30 DAYS", replace(target, run_time=run)
        )
    rows = latest_rows(spark, f"{target.database}.orders", ["o_orderkey"], "changed_at")
    return rows.drop(*RUN_KEYS, "source_table")


def q_reconcile_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A run that lacks some orders, against a source that has lost some and changed the price of others: which they are."""
    orders = table(spark, sf, "orders")
    target = _target(spark)
    lacking = F.col("o_orderstatus").eqNullSafe("O") & F.col("o_orderpriority").eqNullSafe("1-URGENT")
    export_tables(spark, lambda _: orders.filter(~lacking), ["orders"], target, 1)
    dearer = F.col("o_orderstatus").eqNullSafe("F") & F.col("o_orderpriority").eqNullSafe("2-HIGH")
    now = orders.filter(~F.col("o_orderstatus").eqNullSafe("P")).withColumn(
        "o_totalprice", F.when(dearer, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    found = differing_rows(now, run_rows(spark, f"{target.database}.orders", RUN_1, SOURCE), ["o_orderkey"])
    return found.withColumnRenamed("columns", "differing_columns")


def q_committed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that count after each step: a run, one that failed before its commit, its repetition, and two writers that
    were under way at once, the second repeating what the first of them wrote."""
    orders, path = table(spark, sf, "orders"), new_folder(spark, "committed") + "/orders"
    by_status = {s: orders.filter(F.col("o_orderstatus") == s) for s in "FOP"}
    steps = [commit_run(by_status["F"], path, RUN_1, SOURCE, "orders")]
    write_run(orders.limit(1), path, RUN_2, SOURCE, "orders")  # left half-way: nobody commits it
    steps.append(commit_run(by_status["O"], path, RUN_2, SOURCE, "orders"))
    under_way = [write_run(by_status[s], path, RUN_3, f"{SOURCE}_{s}", "orders") for s in "PF"]
    steps += [commit(spark, path, [run]) for run in under_way]
    steps.append(commit_run(by_status["F"], path, RUN_2, SOURCE, "orders"))
    counted = [
        committed_snapshot(spark, path, version)
        .groupBy("source_database", "processing_time", "o_orderstatus")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn("version", F.lit(version))
        for version in steps
    ]
    return reduce(DataFrame.unionAll, counted)


def q_changed_types(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in three runs: sizes as numbers, then as text, and keys that grew from 32 to 64 bits: all of the history."""
    part, path = table(spark, sf, "part"), new_folder(spark, "changed-types") + "/part"
    short = part.select(F.col("p_partkey").cast("int"), F.col("p_size").cast("int"), "p_name")
    sized = part.select(F.col("p_partkey").cast("int"), F.concat("p_size", F.lit(" cm")).alias("p_size"), "p_brand")
    grown = part.select((F.col("p_partkey").cast("long") + 3_000_000_000).alias("p_partkey"), F.col("p_size").cast("string"))
    for run, rows in ((RUN_1, short), (RUN_2, sized), (RUN_3, grown)):
        commit_run(rows, path, run, SOURCE, "part")
    return committed_history(spark, path).drop("source_database", "source_table")


def q_maintained_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The latest dates over three runs of assignments, merged from what each run kept."""
    rows, path = assignments(table(spark, sf, "lineitem")), new_folder(spark, "maintained")
    group, columns = ["emp_no"], ["from_date", "to_date"]
    for i, run in enumerate((RUN_1, RUN_2, RUN_3)):
        keep_partial(rows.filter(F.pmod("dept_no", F.lit(3)) == i), group, columns, path, run, SOURCE)
    return merged_maxima(spark, path, rows.schema, group, columns)


def q_known_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of three runs against an increment that repeats the urgent ones and brings as many new keys."""
    orders, path = table(spark, sf, "orders"), new_folder(spark, "known-keys") + "/orders"
    name = fresh_database(spark, path) + ".orders"
    for run, status in ((RUN_1, "F"), (RUN_2, "O"), (RUN_3, "P")):
        rows = orders.filter(F.col("o_orderstatus") == status)
        count = write_with_metrics(
            rows, partial(snapshot_append, path=path, run_time=run, source_database=SOURCE, source_table="orders")
        )
        keep_key_filter(rows, ["o_orderkey"], count, path, run, SOURCE)
    external_table(spark, name, audit_columns(orders, RUN_1, SOURCE, "orders").schema, path)
    partition_repair(spark, name)
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    new = urgent.unionAll(urgent.select(-F.col("o_orderkey") - 1))
    return known_keys(spark, name, path, new, ["o_orderkey"])


def q_bucketed_assignment(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "bucketed")
    database = fresh_database(spark, folder)
    bucketed_table(assignments(table(spark, sf, "lineitem")), f"{database}.dept_emp", "emp_no", 8, f"{folder}/dept_emp")
    return bucketed_assignment(spark, database)


def q_bucketed_sample_join(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "bucketed")
    database = fresh_database(spark, folder)
    made = interval_tables(*(table(spark, sf, n) for n in ("customer", "orders", "nation")))
    for name, df in zip(("employees", "dept_emp", "departments", "titles"), made, strict=True):
        if name == "departments":
            df.write.option("path", f"{folder}/{name}").saveAsTable(f"{database}.{name}")
        else:
            bucketed_table(df, f"{database}.{name}", "emp_no", 8, f"{folder}/{name}")
    return bucketed_sample_join(spark, database)


QUERIES = {
    "snapshot_append": q_snapshot_append,
    "external_table": q_external_table,
    "partition_repair": q_partition_repair,
    "lake_scan": q_lake_scan,
    "latest_snapshot": q_latest_snapshot,
    "snapshot_overwrite": q_snapshot_overwrite,
    "empty_marker": q_empty_marker,
    "write_with_metrics": q_write_with_metrics,
    "audit_columns": q_audit_columns,
    "sample_rows": q_sample_rows,
    "table_counts": q_table_counts,
    "schema_diff": q_schema_diff,
    "schema_evolution": q_schema_evolution,
    "seed_if_empty": q_seed_if_empty,
    "load_if_unpopulated": q_load_if_unpopulated,
    "full_refresh": q_full_refresh,
    "export_summary": q_export_summary,
    "post_export_check": q_post_export_check,
    "reconcile": q_reconcile,
    "incremental_job": q_incremental_job,
    "changed_rows": q_changed_rows,
    "reconcile_rows": q_reconcile_rows,
    "committed_runs": q_committed_runs,
    "changed_types": q_changed_types,
    "maintained_dates": q_maintained_dates,
    "known_keys": q_known_keys,
    "bucketed_assignment": q_bucketed_assignment,
    "bucketed_sample_join": q_bucketed_sample_join,
}

_TWO_RUNS = f"""
    SELECT o.*, '{RUN_1}' AS processing_time, '{SOURCE}' AS source_database, 'orders' AS source_table FROM orders o
    UNION ALL
    SELECT o.*, '{RUN_2}', '{SOURCE}', 'orders' FROM orders o WHERE o_orderstatus = 'F'"""


def _counts(names, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count{extra} FROM {n}" for n in names)


_AUDIT = "source_table,processing_time,source_database"
_COLUMNS = {
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "nation": "n_nationkey,n_name,n_regionkey",
}

ORACLE = {
    "snapshot_append": f"""
        SELECT processing_time, source_database, source_table, count(*) AS row_count
        FROM ({_TWO_RUNS}) r GROUP BY ALL""",
    "external_table": f"""
        SELECT processing_time, o_orderstatus, count(*) AS row_count FROM ({_TWO_RUNS}) r GROUP BY ALL""",
    "partition_repair": f"""
        SELECT processing_time, count(*) AS row_count, 0 AS rows_before FROM ({_TWO_RUNS}) r GROUP BY ALL""",
    "lake_scan": _TWO_RUNS,
    "latest_snapshot": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "snapshot_overwrite": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "empty_marker": """
        SELECT column_name, type, (SELECT count(*) FROM customer WHERE c_acctbal > 1e12) AS row_count
        FROM (VALUES
            ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'),
            ('c_mktsegment', 'string'), ('processing_time', 'string'), ('source_database', 'string'),
            ('source_table', 'string'), ('is_empty_marker', 'boolean')) v(column_name, type)""",
    "write_with_metrics": _counts(("customer", "orders", "lineitem", "documents")),
    "audit_columns": f"""
        SELECT *, '{RUN_1}' AS processing_time, '{SOURCE}' AS source_database, 'supplier' AS source_table
        FROM supplier""",
    "sample_rows": "SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    "table_counts": _counts(ALL_TABLES),
    "schema_diff": """
        SELECT * FROM (VALUES
            ('o_orderpriority', 'added', NULL, 'string'),
            ('o_orderstatus', 'removed', 'string', NULL)) v(column_name, change, table_type, file_type)""",
    "schema_evolution": f"""
        SELECT '{RUN_1}' AS processing_time, o_orderkey, o_orderstatus, NULL AS o_orderpriority FROM orders
        UNION ALL SELECT '{RUN_2}', o_orderkey, NULL, o_orderpriority FROM orders""",
    "seed_if_empty": """
        SELECT 'empty' AS target, true AS seeded, count(*) AS row_count FROM supplier
        UNION ALL SELECT 'full', false, count(*) FROM customer""",
    "load_if_unpopulated": """
        SELECT 'customer' AS table_name, 'skipped' AS action, count(*) AS row_count FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT 'orders', 'loaded', count(*) FROM orders""",
    "full_refresh": _counts(("customer", "orders")),
    "export_summary": """
        SELECT 'customer' AS table_name, 'ok' AS status, count(*) AS rows_read, count(*) AS rows_written, '' AS changes,
               NULL AS error FROM customer
        UNION ALL SELECT 'supplier', 'failed', NULL, NULL, NULL, 'SchemaChanged'
        UNION ALL SELECT 'part', 'ok', count(*), count(*), 'widened:p_size', NULL FROM part
        UNION ALL SELECT 'orders', 'ok', count(*), count(*), 'added:o_note', NULL FROM orders
        UNION ALL SELECT 'nation', 'ok', count(*), count(*), 'removed:n_regionkey', NULL FROM nation
        UNION ALL SELECT 'absent', 'failed', NULL, NULL, NULL, 'PATH_NOT_FOUND'""",
    "post_export_check": " UNION ALL ".join(
        [
            f"SELECT '{n}' AS table_name, 'ok' AS status, '{_COLUMNS[n]},{_AUDIT}' AS columns, "
            f"count(*) AS row_count, true AS has_rows FROM {n}"
            for n in ("customer", "part", "orders")
        ]
        + [f"SELECT 'nation', 'empty', '{_COLUMNS['nation']},{_AUDIT}', 0, false"]
        + [f"SELECT '{n}', 'failed', NULL, NULL, false" for n in ("supplier", "absent")]
    ),
    "reconcile": """
        SELECT 'customer' AS table_name, count(*) AS source_rows, count(*) AS lake_rows, '' AS missing_columns,
               true AS matches FROM customer
        UNION ALL SELECT 'supplier', count(*), count(*), '', false FROM supplier
        UNION ALL SELECT 'part', count(*), count(*), '', true FROM part
        UNION ALL SELECT 'orders', count(*), count(*), 'o_note', false FROM orders
        UNION ALL SELECT 'nation', count(*) FILTER (n_regionkey <> 0), count(*), '', false FROM nation""",
    "incremental_job": f"""
        SELECT *, CASE WHEN o_orderkey > (SELECT max(o_orderkey) * 4 // 5 FROM orders) THEN '{RUN_2}-increment'
                       ELSE '{RUN_1}' END AS processing_time FROM orders""",
    "changed_rows": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority,
               CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderstatus = 'F' THEN (SELECT max(o_orderdate) FROM orders) + INTERVAL 1 DAY
                    ELSE o_orderdate END AS changed_at
        FROM orders""",
    "reconcile_rows": """
        SELECT o_orderkey, difference, CASE WHEN difference = 'changed' THEN 'o_totalprice' END AS differing_columns
        FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'added'
                                      WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'lost'
                                      WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_totalprice IS NOT NULL
                                      THEN 'changed' END AS difference FROM orders) d
        WHERE difference IS NOT NULL""",
    "committed_runs": f"""
        SELECT v AS version, s AS source_database, t AS processing_time, o_orderstatus, count(*) AS row_count
        FROM orders JOIN (VALUES
            (1, '{SOURCE}', '{RUN_1}', 'F'), (2, '{SOURCE}', '{RUN_2}', 'O'), (3, '{SOURCE}', '{RUN_2}', 'O'),
            (3, '{SOURCE}_P', '{RUN_3}', 'P'), (4, '{SOURCE}', '{RUN_2}', 'O'), (4, '{SOURCE}_P', '{RUN_3}', 'P'),
            (4, '{SOURCE}_F', '{RUN_3}', 'F'), (5, '{SOURCE}', '{RUN_2}', 'F'), (5, '{SOURCE}_P', '{RUN_3}', 'P'),
            (5, '{SOURCE}_F', '{RUN_3}', 'F')) w(v, s, t, status) ON o_orderstatus = status GROUP BY ALL""",
    "changed_types": f"""
        SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_name, NULL AS p_brand, '{RUN_1}' AS processing_time
        FROM part
        UNION ALL SELECT p_partkey, p_size || ' cm', NULL, p_brand, '{RUN_2}' FROM part
        UNION ALL SELECT p_partkey + 3000000000, CAST(p_size AS VARCHAR), NULL, NULL, '{RUN_3}' FROM part""",
    "maintained_dates": f"""
        SELECT emp_no, max(from_date) AS from_date, max(to_date) AS to_date FROM ({ASSIGNMENTS_SQL}) a GROUP BY emp_no""",
    "known_keys": f"""
        SELECT DISTINCT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '{RUN_1}' WHEN 'O' THEN '{RUN_2}' ELSE '{RUN_3}' END
               AS processing_time, '{SOURCE}' AS source_database
        FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O', 'P')""",
    "bucketed_assignment": check_queries.ORACLE["current_assignment"],
    "bucketed_sample_join": check_queries.ORACLE["sample_join"],
}
