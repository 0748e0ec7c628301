"""Every registered query against its SQL on the given tables, and no query without SQL."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402
from lakeload.queries import ORACLE, QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection.sql


def as_text(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, sql, name):
    got, expected = QUERIES[name](spark, str(DATA)), sql(ORACLE[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert as_text(got.columns, got.collect()) == as_text(expected.columns, expected.fetchall())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).columns == ["first_name", "last_name", "dept_name", "title"]
