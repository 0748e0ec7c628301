"""Kept maxima, filters of known keys, and tables laid out for joins."""

import re

import pytest

from lakeload.functions.audit import audit_columns
from lakeload.operators import known_keys as kk
from lakeload.plans.bucketed import bucketed_assignment, bucketed_sample_join, bucketed_table
from lakeload.plans.catalog import create_database, external_table, partition_repair
from lakeload.plans.summaries import keep_partial, merged_maxima
from lakeload.plans.views import current_assignment, latest_dates, sample_join
from lakeload.sinks.lake import snapshot_append

RUNS = [f"2024010{i}T000000Z" for i in range(1, 7)]


def dated(spark, rows):
    return spark.createDataFrame(rows, "emp_no int, dept_no string, f string, t string").selectExpr(
        "emp_no", "dept_no", "CAST(f AS DATE) from_date", "CAST(t AS DATE) to_date"
    )


@pytest.fixture
def database(spark, tmp_path):
    name = "keys_" + tmp_path.name.replace("-", "_")
    create_database(spark, name, f"{tmp_path}/_database")
    return name


def test_merged_maxima_are_the_full_aggregate_and_read_partials_only(spark, tmp_path, rows):
    path, group, columns = str(tmp_path / "t"), ["emp_no"], ["from_date", "to_date"]
    runs = [
        [(1, "a", "2000-01-01", "2001-01-01"), (2, "a", None, None), (None, "b", "1999-01-01", None)],
        [(1, "b", "1990-01-01", "9999-01-01"), (1, "b", "1990-01-01", "9999-01-01")],
        [(3, "c", "2010-01-01", "2011-01-01"), (None, "b", "1998-01-01", "2000-01-01")],
    ]
    everything = dated(spark, [r for run in runs for r in run])
    for run, part in zip(RUNS, runs, strict=False):
        keep_partial(dated(spark, part), group, columns, path, run, "src")
    merged = merged_maxima(spark, path, everything.schema, group, columns)
    assert rows(merged) == rows(latest_dates(everything))
    assert all("/_partials/" in f for f in merged.inputFiles())
    two = merged_maxima(spark, path, everything.schema, group, columns, [("src", RUNS[0]), ("src", RUNS[1])])
    assert rows(two) == rows(latest_dates(dated(spark, runs[0] + runs[1])))
    keep_partial(dated(spark, runs[1]), group, columns, path, RUNS[1], "src")  # a repeated run changes nothing
    assert rows(merged_maxima(spark, path, everything.schema, group, columns)) == rows(latest_dates(everything))
    assert merged_maxima(spark, path, everything.schema, group, columns, []).count() == 0
    keep_partial(dated(spark, []), group, columns, str(tmp_path / "none"), RUNS[0], "src")
    assert merged_maxima(spark, str(tmp_path / "none"), everything.schema, group, columns).count() == 0


def append(spark, database, path, run, df, keep=True, keys=("k",)):
    snapshot_append(df, path, run, "src", "t")
    name = f"{database}.t"
    external_table(spark, name, audit_columns(df, run, "src", "t").schema, path)
    partition_repair(spark, name)
    if keep:
        kk.keep_key_filter(df, keys, df.count(), path, run, "src")
    return name


def test_known_keys_are_found_and_other_runs_not_read(spark, database, tmp_path):
    path = str(tmp_path / "t")
    keyed = "id AS k", "'wide' AS payload"
    append(spark, database, path, RUNS[0], spark.range(0, 1000).selectExpr(*keyed))
    append(spark, database, path, RUNS[1], spark.range(1000, 40000).selectExpr(*keyed))
    name = append(spark, database, path, RUNS[2], spark.range(-500, 5).selectExpr(*keyed))
    new = spark.createDataFrame([(k,) for k in (3, 3, 2000, 999_999_999, None)], "k long")
    found = kk.known_keys(spark, name, path, new, ["k"])
    assert sorted(tuple(r) for r in found.collect()) == [(3, RUNS[0], "src"), (3, RUNS[2], "src"), (2000, RUNS[1], "src")]
    one = kk.known_keys(spark, name, path, new.filter("k = 2000"), ["k"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert RUNS[1] in plan and RUNS[0] not in plan and re.search(r"ReadSchema: struct<k:bigint>", plan)
    assert kk.known_keys(spark, name, path, new.limit(0), ["k"]).count() == 0


def test_filters_miss_no_key_and_ask_few_in_vain(spark, tmp_path):
    path = str(tmp_path / "t")
    held = spark.range(0, 50_000).selectExpr("id % 1000 AS a", "CAST(id AS STRING) AS b")
    kk.keep_key_filter(held, ["a", "b"], 50_000, path, RUNS[0], "src")
    assert kk.may_hold(held, ["a", "b"], path).count() == 50_000
    others = spark.range(50_000, 100_000).selectExpr("id % 1000 AS a", "CAST(id AS STRING) AS b")
    assert kk.may_hold(others, ["a", "b"], path).count() < 0.04 * 50_000


def test_runs_without_a_filter_are_searched_too(spark, database, tmp_path):
    path = str(tmp_path / "t")
    name = append(spark, database, path, RUNS[0], spark.range(10).selectExpr("id AS k"), keep=False)
    new = spark.createDataFrame([(3,), (3,), (77,)], "k long")
    assert [tuple(r) for r in kk.known_keys(spark, name, path, new, ["k"]).collect()] == [(3, RUNS[0], "src")]
    append(spark, database, path, RUNS[1], spark.range(0).selectExpr("id AS k"))
    append(spark, database, path, RUNS[2], spark.range(70, 80).selectExpr("id AS k"))
    got = sorted(tuple(r) for r in kk.known_keys(spark, name, path, new, ["k"]).collect())
    assert got == [(3, RUNS[0], "src"), (77, RUNS[2], "src")]


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield lambda value: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def shuffles(df):
    df.collect()
    return len(re.findall(r"\bExchange (?:hash|range|round|single)", df._jdf.queryExecution().executedPlan().toString()))


def test_bucketed_views_need_no_shuffle(spark, database, tmp_path, rows, no_broadcast):
    no_broadcast("-1")
    assignments = dated(
        spark,
        [(i % 50, f"d{i % 4}", f"200{i % 9}-01-01", "9999-01-01" if i % 3 else f"20{i % 80 + 10}-01-01") for i in range(300)],
    )
    employees = spark.createDataFrame([(i, f"f{i}", f"l{i}") for i in range(50)], "emp_no int, first_name string, last_name string")
    titles = spark.createDataFrame([(i % 50, f"t{i % 3}") for i in range(90)], "emp_no int, title string").selectExpr(
        "*", "DATE '9999-01-01' AS to_date"
    )
    departments = spark.createDataFrame([(f"d{i}", f"name {i}") for i in range(4)], "dept_no string, dept_name string")
    for name, df in (("dept_emp", assignments), ("employees", employees), ("titles", titles)):
        bucketed_table(df, f"{database}.{name}", "emp_no", 8, f"{tmp_path}/{name}")
    departments.write.mode("overwrite").option("path", f"{tmp_path}/departments").saveAsTable(f"{database}.departments")
    current = bucketed_assignment(spark, database)
    assert shuffles(current) == 0 and rows(current) == rows(current_assignment(assignments))
    expected = rows(sample_join(employees, assignments, departments, titles))
    assert rows(bucketed_sample_join(spark, database)) == expected  # departments shuffled too
    size = sum(f.stat().st_size for f in (tmp_path / "departments").glob("*.parquet"))
    no_broadcast(str(size * 2))
    joined = bucketed_sample_join(spark, database)
    assert shuffles(joined) == 0 and rows(joined) == expected
    assert bucketed_sample_join(spark, database, 5).count() == 5
