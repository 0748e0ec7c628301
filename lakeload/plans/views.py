"""Questions over dated intervals: latest dates, current assignment, open rows, the four-table sample join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.specs import OPEN_DATE


def open_rows(df: DataFrame, to_date: str = "to_date") -> DataFrame:
    """Rows whose interval is still open. The comparison is with a literal, so it reaches the Parquet scan."""
    return df.filter(F.col(to_date) == F.lit(OPEN_DATE).cast("date"))


def latest_dates(dept_emp: DataFrame) -> DataFrame:
    """Per employee, the largest start and the largest end, each on its own."""
    return dept_emp.groupBy("emp_no").agg(F.max("from_date").alias("from_date"), F.max("to_date").alias("to_date"))


def current_assignment(dept_emp: DataFrame) -> DataFrame:
    """Assignments that hold both the largest start and the largest end of their employee.

    The two maxima may sit on different rows (the employee is then absent) or on several (all are kept), so this is a
    join on all three columns and not a first row per employee. Joining on the dates too also spreads an employee with
    very many rows over many tasks.
    """
    latest = latest_dates(dept_emp)
    joined = dept_emp.join(latest, ["emp_no", "from_date", "to_date"])
    return joined.select("emp_no", "dept_no", "from_date", "to_date")


def create_views(spark: SparkSession, database: str) -> None:
    """Register both questions as views over ``<database>.dept_emp``."""
    spark.sql(
        f"""CREATE OR REPLACE VIEW {database}.dept_emp_latest_date AS
            SELECT emp_no, max(from_date) AS from_date, max(to_date) AS to_date
            FROM {database}.dept_emp GROUP BY emp_no"""
    )
    spark.sql(
        f"""CREATE OR REPLACE VIEW {database}.current_dept_emp AS
            SELECT emp_no, dept_no, from_date, to_date
            FROM {database}.dept_emp JOIN {database}.dept_emp_latest_date USING (emp_no, from_date, to_date)"""
    )


def sample_join(
    employees: DataFrame, dept_emp: DataFrame, departments: DataFrame, titles: DataFrame, n: int | None = None
) -> DataFrame:
    """Name, department and title of employees by open assignment and open title; any ``n`` rows if given.

    An employee with two open departments and two open titles gives four rows.
    """
    joined = (
        open_rows(dept_emp)
        .select("emp_no", "dept_no")
        .join(departments.select("dept_no", "dept_name"), "dept_no")
        .join(employees.select("emp_no", "first_name", "last_name"), "emp_no")
        .join(open_rows(titles).select("emp_no", "title"), "emp_no")
        .select("first_name", "last_name", "dept_name", "title")
    )
    return joined if n is None else joined.limit(n)
