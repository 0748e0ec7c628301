"""Row rules, keys and references on small tables."""

from datetime import date
from decimal import Decimal
from graphlib import CycleError

import pytest

from lakeload.operators.constraints import (
    cascade_delete,
    fk_clean,
    fk_violations,
    orphan_keys,
    pk_duplicates,
    unique_violations,
)
from lakeload.operators.typed import row_rule_violations, typed_projection
from lakeload.specs import DEPT_EMP, EMPLOYEE_DATABASE, ORDERS, Column, ForeignKey, TableSpec, load_order


def test_typed_projection_converts_and_names_failures(spark):
    text = spark.createDataFrame(
        [
            ("1", "10", "2023-04-10", "99.999"),
            (" 2 ", None, "2023-4-1", "123456789.00"),
            ("2147483648", "x", "2023-02-29", "1e3"),
            (None, "3", "2023", "-5"),
        ],
        "order_id string, customer_id string, order_date string, total_amount string",
    )
    got = [tuple(r) for r in typed_projection(text, ORDERS).collect()]
    assert got == [
        (1, 10, date(2023, 4, 10), Decimal("100.00"), []),
        (2, None, date(2023, 4, 1), None, ["total_amount:type"]),
        (None, None, None, Decimal("1000.00"), ["order_id:type", "customer_id:type", "order_date:type"]),
        (None, 3, None, Decimal("-5.00"), ["order_id:null", "order_date:type"]),
    ]


def test_text_rules(spark):
    spec = TableSpec(
        "t",
        (Column("k", "int", True), Column("c", "char(4)"), Column("v", "varchar(3)"), Column("g", "enum('M','F')", True)),
        primary_key=("k",),
        checks={"k_positive": "k > 0", "v_not_x": "v <> 'x'"},
    )
    df = spark.createDataFrame(
        [(1, "ab  ", "abc  ", "M"), (2, "abcde", "abcd", "m"), (-3, None, "x", None), (4, "abcd ", None, "F")],
        "k int, c string, v string, g string",
    )
    typed = typed_projection(df, spec).collect()
    assert [(r["c"], r["v"]) for r in typed] == [("ab", "abc"), ("abcde", "abcd"), (None, "x"), ("abcd", None)]
    assert sorted(tuple(r) for r in row_rule_violations(df, spec).collect()) == [
        (-3, "check:k_positive"),
        (-3, "check:v_not_x"),
        (-3, "g:null"),
        (2, "c:length"),
        (2, "g:enum"),
        (2, "v:length"),
    ]


def test_texts_that_do_not_convert_are_kept(spark):
    rows = [("1", "10", "2020-13-45", "abc"), ("2", "x", None, "1"), ("3", None, "2020-01-02", "2")]
    text = spark.createDataFrame(rows, "order_id string, customer_id string, order_date string, total_amount string")
    got = [(r["raw"], r["errors"]) for r in typed_projection(text, ORDERS, raw="raw").collect()]
    assert got == [
        ({"order_date": "2020-13-45", "total_amount": "abc"}, ["order_date:type", "total_amount:type"]),
        ({"customer_id": "x"}, ["customer_id:type"]),
        (None, []),
    ]


def test_enum_case_option(spark):
    columns = (Column("g", "enum('M','F')"),)
    df = spark.createDataFrame([("m",)], "g string")
    assert typed_projection(df, TableSpec("t", columns)).first()["errors"] == ["g:enum"]
    assert typed_projection(df, TableSpec("t", columns, ignore_case=True)).first()["errors"] == []


def test_keys(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None)], "k int, u string")
    assert rows(pk_duplicates(df, ["k", "u"])) == [(1, "a", 2), (2, None, 2)]
    assert rows(unique_violations(df, ["u"])) == [("a", 2)]


def test_references_and_nulls(spark, rows):
    fk = ForeignKey(("a", "b"), "p", ("x", "y"))
    child = spark.createDataFrame(
        [(1, 1, "ok"), (1, 2, "orphan"), (None, 2, "null"), (9, None, "null"), (1, 2, "orphan")],
        "a int, b int, n string",
    )
    parent = spark.createDataFrame([(1, 1), (2, 2), (None, 2)], "x int, y int")
    assert rows(orphan_keys(child, fk, parent)) == [(1, 2)]
    assert [r[2] for r in rows(fk_violations(child, fk, parent))] == ["orphan", "orphan"]
    assert sorted(r["n"] for r in fk_clean(child, fk, parent).collect()) == ["null", "null", "ok"]


def test_cascade_through_two_levels_and_two_parents(spark):
    b_spec = TableSpec("b", (Column("id", "int"), Column("a", "int")), ("id",), (), (ForeignKey(("a",), "a", ("id",)),))
    c_spec = TableSpec(
        "c",
        (Column("b", "int"), Column("a", "int")),
        foreign_keys=(ForeignKey(("b",), "b", ("id",)), ForeignKey(("a",), "a", ("id",))),
    )
    a_spec = TableSpec("a", (Column("id", "int"),), ("id",))
    tables = {
        "a": spark.createDataFrame([(1,), (2,)], "id int"),
        "b": spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id int, a int"),
        "c": spark.createDataFrame([(10, 2), (20, 1), (20, 2), (30, None), (None, None)], "b int, a int"),
    }
    left = cascade_delete(tables, [c_spec, b_spec, a_spec], "a", spark.createDataFrame([(1,)], "id int"))
    assert {n: sorted(map(repr, map(tuple, df.collect()))) for n, df in left.items()} == {
        "a": ["(2,)"],
        "b": ["(20, 2)", "(30, None)"],
        "c": ["(20, 2)", "(30, None)", "(None, None)"],
    }


def test_cascade_follows_a_table_that_refers_to_itself(spark):
    tree = TableSpec("t", (Column("id", "int"), Column("up", "int")), ("id",), (), (ForeignKey(("up",), "t", ("id",)),))
    leaf = TableSpec("l", (Column("t", "int"),), foreign_keys=(ForeignKey(("t",), "t", ("id",)),))
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5), (7, 7)]
    tables = {
        "t": spark.createDataFrame(rows, "id int, up int"),
        "l": spark.createDataFrame([(4,), (6,), (None,), (9,)], "t int"),
    }
    left = cascade_delete(tables, [leaf, tree], "t", spark.createDataFrame([(1,)], "id int"))
    assert sorted(r["id"] for r in left["t"].collect()) == [5, 6, 7]
    assert sorted((r["t"] for r in left["l"].collect()), key=repr) == [6, 9, None]
    left = cascade_delete(tables, [tree, leaf], "t", spark.createDataFrame([(7,)], "id int"))
    assert sorted(r["id"] for r in left["t"].collect()) == [1, 2, 3, 4, 5, 6]
    assert cascade_delete(tables, [tree, leaf], "t", spark.createDataFrame([(8,)], "id int"))["t"].count() == 7


def test_tables_in_a_circle_are_refused(spark):
    a = TableSpec("a", (Column("b", "int"),), foreign_keys=(ForeignKey(("b",), "b", ("a",)),))
    b = TableSpec("b", (Column("a", "int"),), foreign_keys=(ForeignKey(("a",), "a", ("b",)),))
    tables = {"a": spark.createDataFrame([(1,)], "b int"), "b": spark.createDataFrame([(1,)], "a int")}
    with pytest.raises(CycleError):
        cascade_delete(tables, [a, b], "a", tables["a"])
    with pytest.raises(ValueError, match="no spec"):
        cascade_delete(tables, [], "a", tables["a"])


def test_load_order_puts_parents_first():
    names = [s.name for s in load_order(reversed(EMPLOYEE_DATABASE))]
    assert sorted(names) == sorted(s.name for s in EMPLOYEE_DATABASE)
    for child in ("dept_emp", "dept_manager", "titles", "salaries"):
        assert names.index("employees") < names.index(child)
    assert names.index("departments") < names.index("dept_emp")
    assert DEPT_EMP.ddl == "`emp_no` int, `dept_no` string, `from_date` date, `to_date` date"
