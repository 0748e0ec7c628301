"""Every query of the subpackage is registered, and those that SQL can express agree with it on the given tables."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402
from lakeload.llm.queries import ORACLE, QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def test_one_query_for_each_operator_and_the_pipeline():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_agrees_with_sql(spark, name):
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got, expected = QUERIES[name](spark, str(DATA)), connection.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(
        tuple(str(r[i]) for i in order) for r in expected.fetchall()
    )
