"""What the registered queries run on: the given tables, and dumps, databases and intervals derived from them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.operators.typed import typed_projection
from lakeload.sinks.jdbc import jdbc_write
from lakeload.sources.jdbc import JdbcSource
from lakeload.specs import Column, TableSpec
from lakeload.workspace import new_folder

# The run times and the source name used by all queries.
RUN_1, RUN_2, RUN_3 = "20240101T000000Z", "20240102T000000Z", "20240103T000000Z"
SOURCE = "sales"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spec_of(df: DataFrame, name: str, **rules) -> TableSpec:
    """A spec with the columns of ``df`` as they are."""
    columns = tuple(Column(f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return TableSpec(name, columns, **rules)


def fresh_database(spark: SparkSession, folder: str) -> str:
    name = f"lakeload_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}/_database'")
    return name


def assignments(lineitem: DataFrame) -> DataFrame:
    """Dated intervals out of line items; an open line status makes an open interval."""
    start = F.col("l_shipdate").cast("date")
    end = F.date_add(start, F.col("l_quantity").cast("int"))
    return lineitem.select(
        F.col("l_orderkey").alias("emp_no"),
        F.col("l_suppkey").alias("dept_no"),
        start.alias("from_date"),
        F.when(F.col("l_linestatus") == "O", F.lit("9999-01-01").cast("date")).otherwise(end).alias("to_date"),
    )


# The same intervals in SQL, for the oracle.
ASSIGNMENTS_SQL = """
    SELECT l_orderkey AS emp_no, l_suppkey AS dept_no, CAST(l_shipdate AS DATE) AS from_date,
           CASE WHEN l_linestatus = 'O' THEN DATE '9999-01-01'
                ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS to_date
    FROM lineitem
"""


def scratch_source(spark: SparkSession, sf: str, *names: str) -> JdbcSource:
    """A fresh embedded database holding the named tables. It lives in this JVM, so it needs a local master."""
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("the embedded database is seen by one process only: run this query with a local master")
    source = JdbcSource(
        f"jdbc:derby:memory:{uuid.uuid4().hex};create=true",
        {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "preferTimestampNTZ": "true"},
        fetch_size=10_000,
    )
    for name in names:
        put(table(spark, sf, name), source, name)
    return source


def put(df: DataFrame, source: JdbcSource, name: str) -> None:
    text = ", ".join(f"{f.name} VARCHAR(4000)" for f in df.schema.fields if f.dataType.simpleString() == "string")
    jdbc_write(df, source, name, batch_size=5000, column_types=text or None)


def _literal(df: DataFrame, name: str, line_ends: bool = False) -> SparkColumn:
    kind = dict(df.dtypes)[name]
    text = F.col(name).cast("string")
    if kind in ("string", "date", "timestamp", "timestamp_ntz"):
        escapes = (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"))
        for raw, escaped in escapes[:2] if line_ends else escapes:
            text = F.replace(text, F.lit(raw), F.lit(escaped))
        text = F.concat(F.lit("'"), text, F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def render_dump(df: DataFrame, name: str, rows_per_statement: int = 1, line_ends: bool = False) -> str:
    """Write ``df`` as INSERT statements and return the folder. Statements are cut within a task, without a shuffle.

    ``line_ends``: those inside texts are written as they are."""
    fields = F.concat_ws(",", *[_literal(df, c, line_ends) for c in df.columns])
    rows = df.select(F.concat(F.lit("("), fields, F.lit(")")).alias("value"))
    opening = f"INSERT INTO `{name}` VALUES "

    def join_rows(chunks):
        import pyarrow as pa

        for chunk in chunks:
            values = chunk.column("value").to_pylist()
            groups = (values[i : i + rows_per_statement] for i in range(0, len(values), rows_per_statement))
            yield pa.RecordBatch.from_pydict({"value": [opening + ",\n".join(g) + ";" for g in groups]})

    if rows_per_statement == 1:
        statements = rows.select(F.concat(F.lit(opening), "value", F.lit(";")).alias("value"))
    else:
        statements = rows.mapInArrow(join_rows, "value string")
    folder = new_folder(df.sparkSession, f"dump-{name}")
    statements.write.text(folder)
    return folder


def write_text(spark: SparkSession, lines: list[str], label: str) -> str:
    """A folder with one file of ``lines``."""
    folder = new_folder(spark, label)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(folder)
    return folder


def as_typed(df: DataFrame, spec: TableSpec) -> DataFrame:
    return typed_projection(df, spec).drop("errors")
