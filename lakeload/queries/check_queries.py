"""Typing, constraint checks, quarantine, insert-ignore, and the questions over intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.operators.constraints import cascade_delete, fk_clean, fk_violations, pk_duplicates, unique_violations
from lakeload.operators.load import insert_ignore
from lakeload.operators.quarantine import Quarantine, batch_summary, quarantine
from lakeload.operators.typed import row_rule_violations, typed_projection
from lakeload.plans.refresh import load_dumps
from lakeload.plans.reports import table_counts
from lakeload.plans.views import create_views, open_rows, sample_join
from lakeload.queries.inputs import (
    ASSIGNMENTS_SQL,
    assignments,
    fresh_database,
    render_dump,
    spec_of,
    table,
    write_text,
)
from lakeload.sources.dump import dump_scan
from lakeload.specs import OPEN_DATE, Column, ForeignKey, TableSpec
from lakeload.workspace import new_folder

LINE_ORDER = ForeignKey(("l_orderkey",), "orders", ("o_orderkey",))
ORDER_CUSTOMER = ForeignKey(("o_custkey",), "customer", ("c_custkey",))


def q_typed_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text, to the declared types; the price of some does not fit its type."""
    orders = table(spark, sf, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    inflated = F.when(F.col("o_orderstatus") == "P", price * 1000).otherwise(price)
    text = orders.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        inflated.cast("string").alias("total_amount"),
        "o_orderpriority",
    )
    spec = TableSpec(
        "orders",
        (
            Column("order_id", "int", True),
            Column("customer_id", "int"),
            Column("order_date", "date"),
            Column("total_amount", "decimal(8,2)"),
            Column("o_orderpriority", "varchar(20)"),
        ),
    )
    typed = typed_projection(text, spec)
    return typed.withColumn("errors", F.array_join("errors", ","))


def q_row_rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    part = part.withColumn("p_type", F.nullif("p_type", F.lit("ECONOMY")))
    spec = TableSpec(
        "part",
        (
            Column("p_partkey", "bigint", True),
            Column("p_name", "varchar(9)", True),
            Column("p_brand", "enum('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5')"),
            Column("p_type", "varchar(25)", True),
            Column("p_size", "int"),
            Column("p_retailprice", "double"),
        ),
        primary_key=("p_partkey",),
        checks={"size_range": "p_size BETWEEN 1 AND 40"},
    )
    return row_rule_violations(part, spec)


def q_pk_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return pk_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def q_unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "part").withColumn("p_name", F.when(F.col("p_size") > 5, F.col("p_name")))
    return unique_violations(named, ["p_name"])


def _kept_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderpriority <> '1-URGENT'")


def q_fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    return fk_violations(table(spark, sf, "lineitem"), LINE_ORDER, _kept_orders(spark, sf))


def q_fk_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that refer to no order (the returned ones here) are clean too."""
    kept = F.when(F.col("l_returnflag") != "R", F.col("l_orderkey"))
    lineitem = table(spark, sf, "lineitem").withColumn("l_orderkey", kept)
    return fk_clean(lineitem, LINE_ORDER, _kept_orders(spark, sf))


def q_cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    tables = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem")}
    specs = [
        spec_of(tables["customer"], "customer"),
        spec_of(tables["orders"], "orders", foreign_keys=(ORDER_CUSTOMER,)),
        spec_of(tables["lineitem"], "lineitem", foreign_keys=(LINE_ORDER,)),
    ]
    keys = tables["customer"].filter("c_nationkey = 0").select("c_custkey")
    return table_counts(cascade_delete(tables, specs[::-1], "customer", keys))


def q_cascade_self(spark: SparkSession, sf: str) -> DataFrame:
    """Customers refer to one another like the nodes of a heap; one near the root goes with all below it."""
    tree = table(spark, sf, "customer").withColumn("above", F.expr("nullif(c_custkey div 2, 0)"))
    spec = spec_of(tree, "customer", foreign_keys=(ForeignKey(("above",), "customer", ("c_custkey",)),))
    keys = tree.filter("c_custkey = 3").select("c_custkey")
    return cascade_delete({"customer": tree}, [spec], "customer", keys)["customer"]


def _line_batches(spark: SparkSession, sf: str) -> tuple[DataFrame, Quarantine]:
    """All lines of an order form a batch; a quantity over 45 breaks a rule."""
    lineitem = table(spark, sf, "lineitem")
    spec = spec_of(lineitem, "lineitem", checks={"quantity": "l_quantity <= 45"})
    return lineitem, quarantine(lineitem, spec, batch="l_orderkey")


def q_batch_quarantine_good(spark: SparkSession, sf: str) -> DataFrame:
    return _line_batches(spark, sf)[1].good


def q_batch_quarantine_bad(spark: SparkSession, sf: str) -> DataFrame:
    return _line_batches(spark, sf)[1].bad


def q_batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows, split = _line_batches(spark, sf)
    return batch_summary("lineitem", rows, split.rejected, batch="l_orderkey")


def q_batch_quarantine_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Each order is a batch, applied by order number: its customer must exist and one order per customer and day."""
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    spec = spec_of(orders, "orders", unique=(("o_custkey", "o_orderdate"),), foreign_keys=(ORDER_CUSTOMER,))
    parents = {"customer": table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")}
    return quarantine(orders, spec, batch="o_orderkey", parents=parents).good


def q_quarantine_null_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Pending orders belong to no batch, so they are one; some customers are not to be served."""
    orders = table(spark, sf, "orders").withColumn("batch", F.expr("nullif(o_orderstatus, 'P')"))
    orders = orders.withColumn("batch", F.concat("batch", F.lit("-"), F.col("o_custkey").cast("string")))
    spec = spec_of(orders, "orders", primary_key=("o_orderkey",), checks={"customer": "o_custkey % 50 <> 7"})
    split = quarantine(orders, spec)
    good = split.good.withColumn("reasons", F.lit(None).cast("string"))
    return good.unionByName(split.bad)


def q_quarantine_target(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines are loaded already: orders that hold one are refused, as are those that repeat a line."""
    lineitem = table(spark, sf, "lineitem")
    spec = spec_of(lineitem, "lineitem", primary_key=("l_orderkey", "l_linenumber"))
    loaded = lineitem.filter("l_returnflag = 'R'")
    return quarantine(lineitem, spec, batch="l_orderkey", target=loaded).rejected


def q_quarantine_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Each order claims its own number and, unless pending and urgent, the next: long chains of overlapping batches."""
    orders = table(spark, sf, "orders")
    ends = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    claims = F.when(ends, F.array("o_orderkey")).otherwise(F.array("o_orderkey", F.col("o_orderkey") + 1))
    rows = orders.select("o_orderkey", F.explode(claims).alias("claim"))
    spec = spec_of(rows, "claims", primary_key=("claim",))
    return quarantine(rows, spec, batch="o_orderkey").rejected


def q_rejected_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Pending orders are not of the declared status, and one statement is cut off: their source text is kept."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    columns = (
        Column("o_orderkey", "bigint", True),
        Column("o_custkey", "bigint"),
        Column("o_orderstatus", "enum('F','O')"),
        Column("o_orderpriority", "varchar(20)"),
    )
    cut = write_text(spark, ["INSERT INTO orders VALUES (1,2,'F','x');", "REPLACE INTO orders VALUES (3);"], "cut")
    more = write_text(spark, ["INSERT INTO orders VALUES (4,'cut"], "cut")
    spec = TableSpec("orders", columns)
    rows = dump_scan(spark, [render_dump(orders, "orders"), cut, more], spec)
    return quarantine(rows, spec).bad.select("raw", "reasons")


def q_load_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Tables from dump files; customers in debt are refused, and so are their orders; one file is cut off, one absent."""
    nation, customer, orders = (table(spark, sf, n) for n in ("nation", "customer", "orders"))
    region, supplier = (table(spark, sf, n) for n in ("region", "supplier"))
    specs = [
        spec_of(region, "region", primary_key=("r_regionkey",)),
        spec_of(supplier, "supplier", primary_key=("s_suppkey",)),
        spec_of(nation, "nation", primary_key=("n_nationkey",), unique=(("n_name",),)),
        spec_of(
            customer,
            "customer",
            primary_key=("c_custkey",),
            foreign_keys=(ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),),
            checks={"balance": "c_acctbal >= 0"},
        ),
        spec_of(orders, "orders", primary_key=("o_orderkey",), foreign_keys=(ORDER_CUSTOMER,)),
    ]
    dumps = {
        "region": [render_dump(region, "region"), write_text(spark, ["INSERT INTO region VALUES (99,'cut"], "cut")],
        "supplier": [new_folder(spark, "absent")],
        "nation": [render_dump(nation, "nation", 1000)],
        "customer": [render_dump(customer, "customer")],
        "orders": [render_dump(orders, "orders")],
    }
    root = new_folder(spark, "loaded")
    database = fresh_database(spark, root)
    summary = load_dumps(spark, specs, dumps, root, database, whole_files=("nation",))
    held = [s.name for s in specs if spark.catalog.tableExists(f"{database}.{s.name}")]
    return summary.join(table_counts({name: spark.table(f"{database}.{name}") for name in held}), "table_name", "left")


def q_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with credit are known by name; all of them come in, twice."""
    customer = table(spark, sf, "customer")
    target = customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("customer_id"), "c_name")
    once = customer.select("c_name", "c_mktsegment", F.lit(0).alias("copy"), F.col("c_custkey").alias("position"))
    incoming = once.union(once.withColumn("copy", F.lit(1)).withColumn("c_mktsegment", F.lit("LATE")))
    return insert_ignore(target, incoming, ["c_name"], "customer_id", order_by=["copy", "position"])


def _view_database(spark: SparkSession, sf: str) -> str:
    folder = new_folder(spark, "views")
    database = fresh_database(spark, folder)
    spark.sql(
        f"""CREATE VIEW {database}.dept_emp AS
            SELECT l_orderkey AS emp_no, l_suppkey AS dept_no, CAST(l_shipdate AS DATE) AS from_date,
                   CASE WHEN l_linestatus = 'O' THEN DATE '{OPEN_DATE}'
                        ELSE date_add(CAST(l_shipdate AS DATE), CAST(l_quantity AS INT)) END AS to_date
            FROM parquet.`{sf}/lineitem.parquet`"""
    )
    create_views(spark, database)
    return database


def q_latest_dates(spark: SparkSession, sf: str) -> DataFrame:
    return spark.table(f"{_view_database(spark, sf)}.dept_emp_latest_date")


def q_current_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return spark.table(f"{_view_database(spark, sf)}.current_dept_emp")


def q_open_interval_filter(spark: SparkSession, sf: str) -> DataFrame:
    return open_rows(assignments(table(spark, sf, "lineitem")))


def interval_tables(
    customer: DataFrame, orders: DataFrame, nation: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Customers as employees, their nations as departments, their orders as titles."""
    open_date = F.lit(OPEN_DATE).cast("date")
    employees = customer.select(
        F.col("c_custkey").alias("emp_no"),
        F.col("c_name").alias("first_name"),
        F.col("c_mktsegment").alias("last_name"),
    )
    dept_emp = customer.select(
        F.col("c_custkey").alias("emp_no"),
        F.col("c_nationkey").alias("dept_no"),
        F.when(F.col("c_acctbal") >= 0, open_date).otherwise(F.lit("2000-01-01").cast("date")).alias("to_date"),
    )
    departments = nation.select(F.col("n_nationkey").alias("dept_no"), F.col("n_name").alias("dept_name"))
    ended = F.date_add(F.col("o_orderdate").cast("date"), 90)
    titles = orders.select(
        F.col("o_custkey").alias("emp_no"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderstatus") == "O", open_date).otherwise(ended).alias("to_date"),
    )
    return employees, dept_emp, departments, titles


def q_sample_join(spark: SparkSession, sf: str) -> DataFrame:
    return sample_join(*interval_tables(*(table(spark, sf, n) for n in ("customer", "orders", "nation"))))


QUERIES = {
    "typed_projection": q_typed_projection,
    "row_rule_violations": q_row_rule_violations,
    "pk_duplicates": q_pk_duplicates,
    "unique_violations": q_unique_violations,
    "fk_violations": q_fk_violations,
    "fk_clean": q_fk_clean,
    "cascade_delete": q_cascade_delete,
    "cascade_self": q_cascade_self,
    "batch_quarantine_good": q_batch_quarantine_good,
    "batch_quarantine_bad": q_batch_quarantine_bad,
    "batch_summary": q_batch_summary,
    "batch_quarantine_keys": q_batch_quarantine_keys,
    "quarantine_null_batch": q_quarantine_null_batch,
    "quarantine_target": q_quarantine_target,
    "quarantine_chains": q_quarantine_chains,
    "rejected_raw": q_rejected_raw,
    "load_dumps": q_load_dumps,
    "insert_ignore": q_insert_ignore,
    "latest_dates": q_latest_dates,
    "current_assignment": q_current_assignment,
    "open_interval_filter": q_open_interval_filter,
    "sample_join": q_sample_join,
}

_LINES = "SELECT * FROM lineitem"
_BAD_BATCHES = "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity > 45)"
_KEPT = "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT'"

ORACLE = {
    "typed_projection": """
        WITH priced AS (
            SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderstatus = 'P' THEN 1000 ELSE 1 END AS price
            FROM orders)
        SELECT CAST(o_orderkey AS INTEGER) AS order_id, CAST(o_custkey AS INTEGER) AS customer_id,
               CAST(o_orderdate AS DATE) AS order_date,
               TRY_CAST(price AS DECIMAL(8,2)) AS total_amount,
               o_orderpriority, CASE WHEN price < 1000000 THEN '' ELSE 'total_amount:type' END AS errors
        FROM priced""",
    "row_rule_violations": """
        SELECT p_partkey, 'p_name:length' AS rule FROM part WHERE length(p_name) > 9
        UNION ALL SELECT p_partkey, 'p_brand:enum' FROM part
            WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')
        UNION ALL SELECT p_partkey, 'p_type:null' FROM part WHERE p_type = 'ECONOMY'
        UNION ALL SELECT p_partkey, 'check:size_range' FROM part WHERE p_size NOT BETWEEN 1 AND 40""",
    "pk_duplicates": """
        SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "unique_violations": """
        SELECT p_name, count(*) AS copies FROM part WHERE p_size > 5 GROUP BY p_name HAVING count(*) > 1""",
    "fk_violations": f"""
        SELECT * FROM lineitem
        WHERE NOT EXISTS (SELECT 1 FROM ({_KEPT}) o WHERE o_orderkey = l_orderkey)""",
    "fk_clean": f"""
        SELECT * REPLACE (CASE WHEN l_returnflag <> 'R' THEN l_orderkey END AS l_orderkey) FROM lineitem
        WHERE l_returnflag = 'R' OR EXISTS (SELECT 1 FROM ({_KEPT}) o WHERE o_orderkey = l_orderkey)""",
    "cascade_delete": """
        WITH c AS (SELECT * FROM customer WHERE c_nationkey <> 0),
             o AS (SELECT * FROM orders WHERE NOT EXISTS (
                 SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey = 0)),
             l AS (SELECT * FROM lineitem WHERE NOT EXISTS (
                 SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey
                 WHERE o_orderkey = l_orderkey AND c_nationkey = 0))
        SELECT 'customer' AS table_name, count(*) AS row_count FROM c
        UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""",
    "cascade_self": """
        WITH RECURSIVE gone(k) AS (SELECT CAST(3 AS BIGINT) UNION ALL
            SELECT c_custkey FROM customer JOIN gone ON c_custkey // 2 = k)
        SELECT *, nullif(c_custkey // 2, 0) AS above FROM customer WHERE c_custkey NOT IN (SELECT k FROM gone)""",
    "quarantine_null_batch": """
        WITH o AS (SELECT *, nullif(o_orderstatus, 'P') || '-' || o_custkey AS batch FROM orders),
             bad AS (SELECT batch, bool_or(o_custkey % 50 = 7) AS refused FROM o GROUP BY batch)
        SELECT o.*, CASE WHEN refused THEN 'check:customer' END AS reasons
        FROM o JOIN bad ON o.batch IS NOT DISTINCT FROM bad.batch""",
    "quarantine_target": """
        WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n, bool_or(l_returnflag = 'R') AS held
                   FROM lineitem GROUP BY ALL),
             b AS (SELECT l_orderkey, bool_or(n > 1) AS twice, bool_or(held) AS held FROM k GROUP BY l_orderkey)
        SELECT l_orderkey, concat_ws(',', CASE WHEN twice THEN 'duplicate:primary_key' END,
                                     CASE WHEN held THEN 'exists:primary_key' END) AS reasons
        FROM b WHERE twice OR held""",
    "quarantine_chains": """
        WITH o AS (SELECT o_orderkey, o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS ends FROM orders),
             l AS (SELECT o.o_orderkey, p.o_orderkey IS NULL OR p.ends AS starts
                   FROM o LEFT JOIN o p ON p.o_orderkey = o.o_orderkey - 1),
             c AS (SELECT o_orderkey, max(CASE WHEN starts THEN o_orderkey END) OVER (ORDER BY o_orderkey) AS first FROM l)
        SELECT o_orderkey, 'key_taken' AS reasons FROM c WHERE (o_orderkey - first) % 2 = 1""",
    "rejected_raw": """
        SELECT concat('(', o_orderkey, ',', o_custkey, ',', chr(39), o_orderstatus, chr(39), ',', chr(39), o_orderpriority,
                      chr(39), ')') AS raw, 'o_orderstatus:enum' AS reasons
        FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
        UNION ALL SELECT 'REPLACE INTO orders VALUES (3)', 'statement'
        UNION ALL SELECT concat('(4,', chr(39), 'cut'), 'syntax'""",
    "batch_quarantine_good": f"{_LINES} WHERE l_orderkey NOT IN ({_BAD_BATCHES})",
    "batch_quarantine_bad": f"SELECT *, 'check:quantity' AS reasons FROM ({_LINES}) WHERE l_orderkey IN ({_BAD_BATCHES})",
    "batch_summary": """
        WITH b AS (SELECT bool_or(l_quantity > 45) AS bad FROM lineitem GROUP BY l_orderkey)
        SELECT 'lineitem' AS table_name, count(*) AS batches, count(*) FILTER (NOT bad) AS loaded,
               count(*) FILTER (bad) AS refused,
               CASE WHEN count(*) FILTER (bad) = 0 THEN 'loaded'
                    WHEN count(*) FILTER (bad) < count(*) THEN 'partial' ELSE 'failed' END AS status
        FROM b""",
    "batch_quarantine_keys": """
        SELECT * EXCLUDE (place) FROM (
            SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate),
                   row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS place
            FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'))
        WHERE place = 1""",
    "load_dumps": """
        WITH counted AS (
            SELECT 'nation' AS table_name, 1 AS batches, 1 AS loaded, count(*) AS row_count, 'ok' AS format FROM nation
            UNION ALL SELECT 'region', count(*) + 1, count(*), count(*), 'unterminated' FROM region
            UNION ALL SELECT 'customer', count(*), count(*) FILTER (c_acctbal >= 0), count(*) FILTER (c_acctbal >= 0), 'ok'
                FROM customer
            UNION ALL SELECT 'orders', count(*), count(*) FILTER (c_acctbal >= 0), count(*) FILTER (c_acctbal >= 0), 'ok'
                FROM orders JOIN customer ON c_custkey = o_custkey)
        SELECT table_name, batches, loaded, batches - loaded AS refused,
               CASE WHEN loaded = batches THEN 'loaded' WHEN loaded > 0 THEN 'partial' ELSE 'failed' END AS status,
               format, NULL AS error, NULL AS earlier, row_count FROM counted
        UNION ALL SELECT 'supplier', 0, 0, 0, 'failed', NULL, 'PATH_NOT_FOUND', NULL, NULL""",
    "insert_ignore": """
        SELECT (SELECT max(c_custkey) FROM customer WHERE c_acctbal >= 0)
                   + row_number() OVER (ORDER BY c_custkey) AS customer_id, c_name, c_mktsegment
        FROM customer WHERE c_acctbal < 0""",
    "latest_dates": f"""
        SELECT emp_no, max(from_date) AS from_date, max(to_date) AS to_date
        FROM ({ASSIGNMENTS_SQL}) a GROUP BY emp_no""",
    "current_assignment": f"""
        WITH a AS ({ASSIGNMENTS_SQL}),
             l AS (SELECT emp_no, max(from_date) AS from_date, max(to_date) AS to_date FROM a GROUP BY emp_no)
        SELECT l.emp_no, dept_no, l.from_date, l.to_date
        FROM a JOIN l ON a.emp_no = l.emp_no AND a.from_date = l.from_date AND a.to_date = l.to_date""",
    "open_interval_filter": f"SELECT * FROM ({ASSIGNMENTS_SQL}) a WHERE to_date = DATE '9999-01-01'",
    "sample_join": """
        SELECT c_name AS first_name, c_mktsegment AS last_name, n_name AS dept_name, o_orderpriority AS title
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey
        WHERE c_acctbal >= 0 AND o_orderstatus = 'O'""",
}
