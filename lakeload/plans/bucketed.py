"""Tables laid out for the joins of the views: rows of one key lie in one bucket, so joins and groups need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeload.plans.views import sample_join


def bucketed_table(df: DataFrame, table: str, key: str, buckets: int, location: str) -> None:
    """Write ``df`` as a table bucketed and sorted by ``key``: one shuffle, once, and one file for each bucket.

    Tables that are joined must have the same number of buckets; one for every 128 MB of the largest of them is a good
    number. A key that holds a large share of the rows makes a large bucket: such tables are better left unbucketed,
    for Spark can split a hot key only where it shuffles.
    """
    laid_out = df.repartition(buckets, key)
    laid_out.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", location).saveAsTable(table)


def bucketed_assignment(spark: SparkSession, database: str) -> DataFrame:
    """``current_assignment`` over the bucketed ``dept_emp``, in one scan.

    The join of ``current_assignment`` is on three columns, for which Spark shuffles a table bucketed by one. Here each row
    meets the maxima of its employee within the bucket, which is sorted by employee already.
    """
    rows = spark.table(f"{database}.dept_emp").select("emp_no", "dept_no", "from_date", "to_date")
    employee = Window.partitionBy("emp_no")
    latest = rows.filter("emp_no IS NOT NULL").withColumns(
        {"_from": F.max("from_date").over(employee), "_to": F.max("to_date").over(employee)}
    )
    return latest.filter("from_date = _from AND to_date = _to").drop("_from", "_to")


def bucketed_sample_join(spark: SparkSession, database: str, n: int | None = None) -> DataFrame:
    """``sample_join`` over ``employees``, ``dept_emp`` and ``titles`` bucketed by ``emp_no``.

    Departments are few: Catalyst broadcasts them if their written size is under the session's threshold. Beyond it that
    one join shuffles, and the plan is as without buckets.
    """
    return sample_join(*(spark.table(f"{database}.{t}") for t in ("employees", "dept_emp", "departments", "titles")), n)
