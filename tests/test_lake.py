"""Snapshots, markers, catalog, schema changes, views and reports."""

from datetime import UTC, date, datetime
from functools import partial

import pytest

from lakeload.__main__ import main
from lakeload.functions.audit import audit_columns, run_time_label
from lakeload.plans.catalog import external_table, file_schema, partition_repair, schema_diff, schema_evolution
from lakeload.plans.export import Target, export_tables, failed
from lakeload.plans.refresh import complete, full_refresh, load_dumps
from lakeload.plans.reports import post_export_check, reconcile, run_rows, table_counts
from lakeload.plans.views import create_views, current_assignment, latest_dates, open_rows, sample_join
from lakeload.sinks.lake import empty_marker, marker_path, snapshot_append, snapshot_overwrite, write_with_metrics
from lakeload.sources.lake import increment_mark, latest_snapshot, sample_rows
from lakeload.specs import DEPARTMENTS, DEPT_EMP, EMPLOYEE_DATABASE, EMPLOYEES

OPEN = date(9999, 1, 1)
RUN_1, RUN_2 = "20240101T000000Z", "20240102T000000Z"


@pytest.fixture
def database(spark, tmp_path):
    name = "db_" + tmp_path.name.replace("-", "_")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/_database'")
    return name


def numbers(spark, n):
    return spark.range(n).selectExpr("CAST(id AS INT) AS k", "concat('v', id) AS v")


def test_run_label_sorts_and_reads_back_as_text(spark, tmp_path):
    label = run_time_label(datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC))
    assert label == "20240506T070809Z" < run_time_label(datetime(2024, 5, 6, 7, 8, 10, tzinfo=UTC))
    snapshot_append(numbers(spark, 1), str(tmp_path / "t"), label, "hr", "t")
    back = spark.read.parquet(str(tmp_path / "t"))
    assert dict(back.dtypes)["processing_time"] == "string" and back.first()["processing_time"] == label


def test_append_keeps_history_and_rerun_replaces_its_own_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshot_append(numbers(spark, 3), path, RUN_1, "hr", "t")
    snapshot_append(numbers(spark, 5), path, RUN_2, "hr", "t")
    snapshot_append(numbers(spark, 4), path, RUN_2, "hr", "t")
    snapshot_append(numbers(spark, 2), path, RUN_2, "crm", "t")
    counts = spark.read.parquet(path).groupBy("processing_time", "source_database").count()
    assert sorted(map(tuple, counts.collect())) == [(RUN_1, "hr", 3), (RUN_2, "crm", 2), (RUN_2, "hr", 4)]


def test_repair_and_latest_snapshot_prune_partitions(spark, tmp_path, database):
    path, name = str(tmp_path / "t"), f"{database}.t"
    for run, source, n in ((RUN_1, "hr", 3), (RUN_2, "hr", 5), (RUN_1, "crm", 7)):
        snapshot_append(numbers(spark, n), path, run, source, "t")
    external_table(spark, name, audit_columns(numbers(spark, 1), RUN_1, "hr", "t").schema, path)
    assert spark.table(name).count() == 0
    partition_repair(spark, name)
    assert spark.table(name).count() == 15
    latest = latest_snapshot(spark, name)
    assert latest.count() == 12
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(((source_database" in plan


def test_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (5, 3, 3):
        snapshot_overwrite(numbers(spark, n), path)
        assert spark.read.parquet(path).count() == n


def test_count_is_taken_while_writing(spark, tmp_path):
    assert write_with_metrics(numbers(spark, 7), partial(snapshot_overwrite, path=str(tmp_path / "a"))) == 7
    assert write_with_metrics(numbers(spark, 0), partial(snapshot_overwrite, path=str(tmp_path / "b"))) == 0


def test_marker_stays_out_of_the_table(spark, tmp_path):
    root = str(tmp_path)
    path = empty_marker(spark, numbers(spark, 1).schema, root, "t", RUN_1, "hr")
    marker = spark.read.parquet(path)
    assert path == marker_path(root, "t") and not path.startswith(f"{root}/t/")
    assert marker.count() == 0 and dict(marker.dtypes)["is_empty_marker"] == "boolean"


def test_schema_evolution_adds_and_reports(spark, tmp_path, database, rows):
    path, name = str(tmp_path / "t"), f"{database}.t"
    old = audit_columns(numbers(spark, 2), RUN_1, "hr", "t")
    new = spark.range(1).selectExpr("id AS k", "'n' AS extra")
    snapshot_append(numbers(spark, 2), path, RUN_1, "hr", "t")
    external_table(spark, name, old.schema, path)
    partition_repair(spark, name)
    added = f"{path}/processing_time={RUN_2}/source_database=hr"
    snapshot_append(new.withColumn("k", new["k"].cast("int")), path, RUN_2, "hr", "t")
    added = file_schema(spark, added)
    assert rows(schema_diff(spark, name, added)) == [("extra", "added", None, "string"), ("v", "removed", "string", None)]
    schema_evolution(spark, name, added)
    partition_repair(spark, name)
    got = rows(spark.table(name).select("k", "v", "extra"))
    assert got == [(0, "v0", None), (0, None, "n"), (1, "v1", None)]
    assert rows(schema_diff(spark, name, added)) == [("v", "removed", "string", None)]
    snapshot_overwrite(new, str(tmp_path / "retyped"))
    retyped = file_schema(spark, str(tmp_path / "retyped"))
    assert ("k", "type_changed", "int", "bigint") in rows(schema_diff(spark, name, retyped))


def periods(spark, values):
    as_dates = [(e, d, date.fromisoformat(a), date.fromisoformat(b)) for e, d, a, b in values]
    return spark.createDataFrame(as_dates, "emp_no int, dept_no string, from_date date, to_date date")


PERIODS = [
    (1, "d1", "2000-01-01", "2001-01-01"),
    (1, "d2", "2001-01-01", "9999-01-01"),  # both maxima on one row
    (2, "d1", "2000-01-01", "9999-01-01"),
    (2, "d2", "2005-01-01", "2006-01-01"),  # maxima on different rows: none
    (3, "d1", "2000-01-01", "9999-01-01"),
    (3, "d2", "2000-01-01", "9999-01-01"),  # a tie: both
]


def test_views_keep_the_independent_maxima(spark, tmp_path, database, rows):
    dept_emp = periods(spark, PERIODS)
    assert len(rows(latest_dates(dept_emp))) == 3
    expected = [
        (1, "d2", date(2001, 1, 1), OPEN),
        (3, "d1", date(2000, 1, 1), OPEN),
        (3, "d2", date(2000, 1, 1), OPEN),
    ]
    assert rows(current_assignment(dept_emp)) == expected
    snapshot_overwrite(dept_emp, str(tmp_path / "dept_emp"))
    external_table(spark, f"{database}.dept_emp", DEPT_EMP.schema, str(tmp_path / "dept_emp"), ())
    create_views(spark, database)
    assert rows(spark.table(f"{database}.current_dept_emp")) == expected
    assert rows(spark.table(f"{database}.dept_emp_latest_date")) == rows(latest_dates(dept_emp))


def test_sample_join_fans_out(spark):
    names = "emp_no int, first_name string, last_name string"
    employees = spark.createDataFrame([(1, "Ann", "Lee"), (2, "Bo", "Ray")], names)
    opened, closed = ("2000-01-01", "9999-01-01"), ("1990-01-01", "2000-01-01")
    dept_emp = periods(spark, [(1, "d1", *opened), (1, "d2", *opened), (2, "d1", *closed)])
    departments = spark.createDataFrame([("d1", "Sales"), ("d2", "Legal")], "dept_no string, dept_name string")
    titles = periods(spark, [(1, "Clerk", *opened), (1, "Head", *opened), (1, "Aide", *closed), (2, "Head", *opened)])
    titles = titles.withColumnRenamed("dept_no", "title")
    joined = sample_join(employees, dept_emp, departments, titles)
    assert joined.count() == 4 and joined.columns == ["first_name", "last_name", "dept_name", "title"]
    assert sample_join(employees, dept_emp, departments, titles, n=3).count() == 3


def test_counts_and_samples(spark, rows):
    assert rows(table_counts({"a": numbers(spark, 3), "none": numbers(spark, 0)})) == [("a", 3), ("none", 0)]
    assert sample_rows(numbers(spark, 9), 4).count() == 4
    assert [r["k"] for r in sample_rows(numbers(spark, 9), 2, ["k"]).collect()] == [0, 1]


def test_reconcile_sees_every_kind_of_difference(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", "c"), (2, "b", "c")], "k int, v string, w string")
    pairs = {
        "same": (base, base.orderBy("v").withColumn("source_table", base["v"])),
        "fewer": (base, base.limit(2)),
        "changed": (base, base.withColumn("v", base["w"])),
        "moved_null": (base.filter("k = 1"), spark.createDataFrame([(1, None, "a")], base.schema)),
        "other_pair": (base.filter("k = 2"), base.filter("k = 2").selectExpr("k + 1 AS k", "v", "w")),
        "empty": (base.limit(0), base.limit(0)),
        "lost": (base, base.limit(0)),
    }
    matches = {r["table_name"]: r["matches"] for r in reconcile(pairs).collect()}
    assert {n for n, same in matches.items() if same} == {"same", "empty"} and len(matches) == len(pairs)


def test_export_goes_on_after_a_failure_and_can_be_repeated(spark, tmp_path):
    root, tables = str(tmp_path), {"a": numbers(spark, 3), "none": numbers(spark, 0)}
    tries = []

    def read(name):
        if name == "flaky" and not tries:
            tries.append(name)
            raise OSError("password=secret")
        return numbers(spark, 2) if name == "flaky" else tables[name]

    database = "db_" + tmp_path.name.replace("-", "_")
    target = Target(root, database, RUN_1, "hr")
    for _ in range(2):
        summary = export_tables(spark, read, ["a", "none", "absent", "flaky"], target, max_attempts=2)
        assert {r["table_name"]: tuple(r)[1:] for r in summary.collect()} == {
            "a": ("ok", 3, 3, "", None),
            "none": ("empty", 0, 0, "", None),
            "absent": ("failed", None, None, None, "KeyError"),
            "flaky": ("ok", 2, 2, "", None),
        }
        assert failed(summary) and not failed(summary.filter("table_name = 'a'"))
    later = export_tables(spark, lambda name: numbers(spark, 5), ["a"], Target(root, database, RUN_2, "hr"))
    assert later.first()["rows_written"] == 5
    assert spark.table(f"{database}.a").count() == 8
    assert latest_snapshot(spark, f"{database}.a").count() == 5
    report = post_export_check(spark, database, ["a", "none", "absent"], RUN_1, "hr")
    check = {r["table_name"]: r for r in report.collect()}
    assert [check[n]["status"] for n in ("a", "none", "absent")] == ["ok", "empty", "failed"]
    assert check["a"]["columns"] == "k,v,source_table,processing_time,source_database" and check["a"]["row_count"] == 3
    assert spark.read.parquet(marker_path(root, "none")).count() == 0
    absent = post_export_check(spark, database, ["a", "none"], RUN_2, "hr").collect()
    assert {r["table_name"]: (r["status"], r["row_count"]) for r in absent} == {"a": ("ok", 5), "none": ("failed", None)}


def test_changed_type_fails_the_table_and_leaves_it_readable(spark, tmp_path):
    database = "db_" + tmp_path.name.replace("-", "_")

    def export(run, *columns):
        target = Target(str(tmp_path), database, run, "hr")
        rows = spark.range(2).selectExpr(*columns)
        return tuple(export_tables(spark, lambda name: rows, ["a"], target).first())[1:]

    assert export(RUN_1, "id AS k", "CAST(id AS INT) AS n", "'x' AS v") == ("ok", 2, 2, "", None)
    assert export(RUN_2, "CAST(id AS SMALLINT) AS k", "CAST(id AS INT) AS n", "'x' AS v") == ("ok", 2, 2, "widened:k", None)
    assert export("3", "id AS k", "id AS n", "'x' AS v") == ("failed", None, None, None, "SchemaChanged")
    assert export("4", "id AS k", "'y' AS extra") == ("ok", 2, 2, "added:extra,removed:n,removed:v", None)
    assert len(spark.table(f"{database}.a").collect()) == 6  # every run can still be read
    assert latest_snapshot(spark, f"{database}.a").select("k", "n", "extra").orderBy("k").collect()[0] == (0, None, "y")


def test_what_a_run_wrote_is_queried(spark, tmp_path, monkeypatch):
    database = "db_" + tmp_path.name.replace("-", "_")
    monkeypatch.setattr("lakeload.plans.export.check_run", lambda *a: 1)
    target = Target(str(tmp_path), database, RUN_1, "hr")
    summary = export_tables(spark, lambda name: numbers(spark, 3), ["a"], target, max_attempts=1)
    assert tuple(summary.first())[1:] == ("failed", None, None, None, "CheckFailed") and failed(summary)


def test_a_failing_write_keeps_the_runs_before(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshot_append(numbers(spark, 3), path, RUN_1, "hr", "t")
    broken = numbers(spark, 4).selectExpr("CAST(raise_error('no') AS INT) AS k", "v")
    with pytest.raises(Exception, match="no"):
        snapshot_append(broken, path, RUN_2, "hr", "t")
    assert spark.read.parquet(path).count() == 3


def test_increments_and_full_runs_make_the_latest_state(spark, tmp_path):
    database = "db_" + tmp_path.name.replace("-", "_")

    def export(run, n):
        target = Target(str(tmp_path), database, run, "hr")
        summary = export_tables(spark, lambda name: numbers(spark, n), ["a"], target, increments={"a": "k"})
        return tuple(summary.first())[1:4]

    latest = lambda: sorted(r["k"] for r in latest_snapshot(spark, f"{database}.a").collect())
    assert export("1", 3) == ("ok", 3, 3) and latest() == [0, 1, 2]  # nothing there yet: a full run
    assert export("2", 5) == ("ok", 2, 2) and latest() == [0, 1, 2, 3, 4]
    assert export("3", 5) == ("empty", 0, 0) and latest() == [0, 1, 2, 3, 4]
    assert export("4", 6) == ("ok", 1, 1) and latest() == [0, 1, 2, 3, 4, 5]
    full = Target(str(tmp_path), database, "5", "hr")
    export_tables(spark, lambda name: numbers(spark, 2), ["a"], full)
    assert latest() == [0, 1]
    assert export("6", 4) == ("ok", 2, 2) and latest() == [0, 1, 2, 3]
    assert increment_mark(spark, f"{database}.a", "k", "hr") == 3 and increment_mark(spark, f"{database}.a", "k", "x") is None
    run = run_rows(spark, f"{database}.a", "6-increment", "hr")
    report = reconcile({"a": (numbers(spark, 4).filter("k > 1"), run), "b": (numbers(spark, 4), run.drop("v"))}).collect()
    assert {r["table_name"]: (r["matches"], r["missing_columns"]) for r in report} == {"a": (True, ""), "b": (False, "v")}


def test_empty_run_is_the_latest_snapshot(spark, tmp_path):
    database, rows_now = "db_" + tmp_path.name.replace("-", "_"), [3]

    def export(run):
        target = Target(str(tmp_path), database, run, "h'r")
        return export_tables(spark, lambda name: numbers(spark, rows_now[0]), ["a"], target).first()["status"]

    assert export(RUN_1) == "ok"
    rows_now[0] = 0
    assert export(RUN_2) == "empty"
    assert latest_snapshot(spark, f"{database}.a").count() == 0 and spark.table(f"{database}.a").count() == 3
    assert export(RUN_1) == "empty"
    assert spark.table(f"{database}.a").count() == 0
    rows_now[0] = 2
    assert export(RUN_2) == "ok"
    assert latest_snapshot(spark, f"{database}.a").count() == 2


def test_open_rows_reach_the_scan(spark, tmp_path):
    periods(spark, PERIODS).write.parquet(str(tmp_path / "p"))
    found = open_rows(spark.read.parquet(str(tmp_path / "p")))
    assert found.count() == 4
    assert "PushedFilters: [IsNotNull(to_date), EqualTo(to_date,9999-01-01)]" in found._jdf.queryExecution().toString()


def test_awkward_source_name(spark, tmp_path):
    database = "db_" + tmp_path.name.replace("-", "_")
    target = Target(str(tmp_path), database, RUN_1, "h'r +%1:\\/x")
    assert not failed(export_tables(spark, lambda name: numbers(spark, 3), ["a"], target, max_attempts=1))
    assert spark.table(f"{database}.a").first()["source_database"] == target.source_database
    assert latest_snapshot(spark, f"{database}.a").count() == 3


EMPLOYEE = "({0},'1960-01-02','Ann','Lee','F','1990-05-06')"
FILES = {
    "departments": "INSERT INTO departments VALUES ('d001','Sales'),('d002','Legal');\n",
    "employees": (
        f"INSERT INTO employees VALUES {EMPLOYEE.format(1)},{EMPLOYEE.format(2)};\n"
        f"INSERT INTO employees VALUES {EMPLOYEE.format(3)},{EMPLOYEE.format(2)};\n"
        f"INSERT INTO employees VALUES {EMPLOYEE.format(3)};\n"
    ),
    "dept_manager": (
        "INSERT INTO dept_manager VALUES (1,'d001','1990-01-01','9999-01-01');\n"
        "INSERT INTO dept_manager VALUES (9,'d001','1990-01-01','9999-01-01');\n"
    ),
    "dept_emp": (
        "INSERT INTO dept_emp VALUES (1,'d001','1990-01-01','9999-01-01'),(2,'d002','1990-01-01','9999-01-01');\n"
        "INSERT INTO dept_emp VALUES (3,'d003','1990-01-01','9999-01-01');\n"
    ),
    "titles": "INSERT INTO titles VALUES (1,'Clerk','1990-01-01',NULL);\n",
    "salaries1": "INSERT INTO salaries VALUES (1,60117,'1986-06-26','1987-06-26');\n",
    "salaries2": "INSERT INTO salaries VALUES (1,60118,'1986-06-26','1987-06-26');\n",
    "salaries3": "INSERT INTO salaries VALUES (3,60117,'1986-06-26','1987-06-26');\n",
}


def test_whole_database_from_dumps_then_refresh(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.dump").write_text(text)
    parts = {t.name: [str(tmp_path / f"{t.name}.dump")] for t in EMPLOYEE_DATABASE if t.name != "salaries"}
    parts["salaries"] = [str(tmp_path / f"salaries{i}.dump") for i in (1, 2, 3)]
    root, database = str(tmp_path / "lake"), "db_" + tmp_path.name.replace("-", "_")
    whole = ("departments", "dept_manager")
    summary = load_dumps(spark, EMPLOYEE_DATABASE, parts, root, database, whole, views=create_views)
    assert {r["table_name"]: (r["batches"], r["loaded"], r["status"], r["format"]) for r in summary.collect()} == {
        "departments": (1, 1, "loaded", "ok"),
        "employees": (3, 2, "partial", "ok"),
        "dept_manager": (1, 0, "failed", "ok"),
        "dept_emp": (2, 1, "partial", "ok"),
        "titles": (1, 1, "loaded", "ok"),
        "salaries": (3, 2, "partial", "ok"),
    }
    assert spark.table(f"{database}.current_dept_emp").count() == 2
    refused = spark.read.parquet(f"{root}/_rejected/dept_emp").first()
    assert refused["reasons"] == "foreign_key:dept_no"
    again = load_dumps(spark, EMPLOYEE_DATABASE, parts, root, database, whole)
    assert {r["table_name"]: (r["status"], r["earlier"]) for r in again.collect()} == {
        "departments": ("skipped", "loaded"),
        "employees": ("skipped", "partial"),
        "dept_manager": ("failed", None),  # the only table still empty
        "dept_emp": ("skipped", "partial"),
        "titles": ("skipped", "loaded"),
        "salaries": ("skipped", "partial"),
    }
    assert not complete(again) and complete(again.filter("table_name IN ('departments', 'titles')"))

    where = ["--dumps", str(tmp_path), "--root", root, "--database", database]
    for name in FILES:
        (tmp_path / f"load_{name}.dump").write_text(FILES[name])
    assert main(["load-dumps", "--refresh", *where]) == 1  # some batches are refused again
    assert spark.table(f"{database}.employees").count() == 3

    kept = {"departments": DEPARTMENTS, "employees": EMPLOYEES, "dept_emp": DEPT_EMP}
    copies = {n: spark.createDataFrame(spark.table(f"{database}.{n}").collect(), s.schema) for n, s in kept.items()}
    counts = full_refresh(spark, list(kept.values()), copies.__getitem__, root, database, create_views)
    assert sorted(map(tuple, counts.collect())) == [("departments", 2), ("dept_emp", 2), ("employees", 3)]
    assert spark.table(f"{database}.current_dept_emp").count() == 2


def test_absent_and_cut_files_are_reported_and_do_not_stop_the_others(spark, tmp_path):
    (tmp_path / "d.dump").write_text(FILES["departments"] + "INSERT INTO departments VALUES ('d003','Cut')")
    (tmp_path / "t.dump").write_text(FILES["titles"])
    (tmp_path / "m.dump").write_text("1,d001\n")
    dumps = {"departments": [str(tmp_path / "d.dump")], "employees": [str(tmp_path / "absent.dump")]}
    dumps |= {"titles": [str(tmp_path / "t.dump")], "dept_manager": [str(tmp_path / "m.dump")], "salaries": []}
    names = ("departments", "employees", "titles", "dept_manager")
    specs = [s for s in EMPLOYEE_DATABASE if s.name in names]
    database = "db_" + tmp_path.name.replace("-", "_")
    summary = load_dumps(spark, specs, dumps, str(tmp_path / "lake"), database)
    assert {r["table_name"]: tuple(r)[1:7] for r in summary.collect()} == {
        "departments": (2, 2, 0, "loaded", "unterminated", None),
        "employees": (0, 0, 0, "failed", None, "PATH_NOT_FOUND"),
        "titles": (1, 0, 1, "failed", "ok", None),  # its parent holds no row
        "dept_manager": (1, 0, 1, "failed", "unexpected_format", None),
    }
    assert not complete(summary) and not complete(summary.filter("table_name = 'departments'"))
    refused = spark.read.parquet(str(tmp_path / "lake/_rejected/dept_manager")).first()
    assert (refused["reasons"], refused["raw"]) == ("statement", "1,d001")


def test_a_refresh_that_fails_half_way_leaves_what_was_there(spark, tmp_path, rows):
    database, root = "db_" + tmp_path.name.replace("-", "_"), str(tmp_path)
    specs = [DEPARTMENTS, EMPLOYEES]
    old = {"departments": [("d001", "Sales")], "employees": [(1, date(1960, 1, 2), "Ann", "Lee", "F", date(1990, 5, 6))]}
    read = lambda name: spark.createDataFrame(old[name], next(s for s in specs if s.name == name).schema)
    view = lambda spark, db: spark.sql(f"CREATE OR REPLACE VIEW {db}.names AS SELECT dept_name FROM {db}.departments")
    full_refresh(spark, specs, read, root, database, view)

    def broken(name):
        if name == "employees":
            raise OSError("gone")
        return spark.createDataFrame([("d009", "New")], DEPARTMENTS.schema)

    with pytest.raises(OSError):
        full_refresh(spark, specs, broken, root, database, view)
    assert rows(spark.table(f"{database}.names")) == [("Sales",)] and spark.table(f"{database}.employees").count() == 1
    twice = lambda name: spark.table(f"{database}.{name}").union(read(name))  # noqa: E731  from the tables themselves
    counts = full_refresh(spark, specs, twice, root, database)
    assert rows(counts) == [("departments", 2), ("employees", 2)]
    assert not spark.catalog.tableExists(f"{database}.names")  # every view goes, whatever its name


def test_a_clean_reload_leaves_no_refused_rows(spark, tmp_path):
    spec = next(s for s in EMPLOYEE_DATABASE if s.name == "departments")
    dump, root, database = tmp_path / "d.dump", str(tmp_path / "lake"), "reload_" + tmp_path.name.replace("-", "_")
    for text, refused in (("('d001','A'),('d001','B');", 2), ("('d001','A'),('d002','B');", 0)):
        dump.write_text(f"INSERT INTO `departments` VALUES {text}\n")
        load_dumps(spark, [spec], {"departments": [str(dump)]}, root, database, refresh=True)
        assert spark.read.parquet(f"{root}/_rejected/departments").count() == refused
