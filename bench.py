"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose data and cores. Each query runs once to
warm up and then BENCH_RUNS times (default 3); the best run counts. Results are consumed by Spark's no-op sink, so every
row and column is produced and nothing goes through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from functools import partial
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lakeload.operators.quarantine import quarantine  # noqa: E402
from lakeload.queries import QUERIES  # noqa: E402
from lakeload.queries.inputs import render_dump, scratch_source, spec_of, table  # noqa: E402
from lakeload.sinks.lake import snapshot_overwrite, write_with_metrics  # noqa: E402
from lakeload.sources.dump import dump_scan  # noqa: E402
from lakeload.sources.jdbc import jdbc_scan, jdbc_scan_partitioned  # noqa: E402
from lakeload.workspace import new_folder  # noqa: E402

HEADLINE = (
    "current_assignment sample_join latest_dates open_interval_filter table_counts pk_duplicates unique_violations "
    "fk_violations fk_clean cascade_delete row_rule_violations typed_projection batch_quarantine_good "
    "batch_quarantine_keys batch_summary insert_ignore incremental_extract snapshot_append snapshot_overwrite "
    "write_with_metrics schema_evolution export_summary reconcile dump_scan multi_part_load"
).split()


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(action, runs: int) -> float:
    action()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def comparisons(spark: SparkSession, sf: str) -> dict:
    """Pairs of ways to do the same work; the inputs are prepared outside the timed part."""
    source = scratch_source(spark, sf, "orders")
    orders, lineitem, documents = (table(spark, sf, n) for n in ("orders", "lineitem", "documents"))
    texts = documents.select("doc_id", "text", "lang", "n_chars")
    dumped, dumped_orders = [render_dump(texts, "documents")], [render_dump(orders, "orders", 100)]
    spec = spec_of(lineitem, "lineitem", checks={"quantity": "l_quantity <= 45"})

    def count_then_write():
        from_database = jdbc_scan(spark, source, "orders")
        from_database.count()
        snapshot_overwrite(from_database, new_folder(spark, "bench"))

    def count_while_writing():
        from_database = jdbc_scan(spark, source, "orders")
        write_with_metrics(from_database, partial(snapshot_overwrite, path=new_folder(spark, "bench")))

    return {
        "jdbc_1_partition": lambda: consume(jdbc_scan(spark, source, "orders")),
        "jdbc_4_partitions": lambda: consume(jdbc_scan_partitioned(spark, source, "orders", "o_orderkey", 4)),
        "write_after_count": count_then_write,
        "write_with_count": count_while_writing,
        "parse_documents_dump": lambda: dump_scan(spark, dumped, spec_of(texts, "documents")),
        "parse_orders_dump": lambda: dump_scan(spark, dumped_orders, spec_of(orders, "orders")),
        "load_plain": lambda: snapshot_overwrite(lineitem, new_folder(spark, "bench")),
        "load_with_quarantine": lambda: snapshot_overwrite(
            quarantine(lineitem, spec, batch="l_orderkey").good, new_folder(spark, "bench")
        ),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lakeload-bench")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lakeload-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: best(lambda name=name: consume(QUERIES[name](spark, sf)), runs) for name in HEADLINE}
    compared = {name: best(action, runs) for name, action in comparisons(spark, sf).items()}
    orders = table(spark, sf, "orders").count()
    print(
        json.dumps(
            {
                "metric": "sum of best times of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf).name,
                "comparisons": compared,
                "dump_rows_per_second": round(orders / compared["parse_orders_dump"]),
            }
        )
    )


if __name__ == "__main__":
    main()
