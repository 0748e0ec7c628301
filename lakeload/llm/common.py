"""What several operators share: words, row identity and places in order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeload.operators.components import components
from lakeload.workspace import stage

__all__ = ["components", "ordered", "same_names", "shingle_blocks", "small_batches", "table", "text_tag", "word_blocks", "WORD"]

#: A word, for Spark's and SQL's regular expressions: anything but a blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
#: Texts longer than this are cut into words piece by piece, so that memory stays bounded.
LONG_TEXT, WORDS_AT_ONCE = 1 << 22, 1 << 16


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Have Spark hand at most ``rows`` texts at a time to Python, unless the session sets a number of its own.

    Texts are long; with Spark's 10,000 rows a batch of them can take more memory than all else in a Python worker.
    """
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, str(rows))


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded length; one list for all but very long texts."""
    if len(data) <= LONG_TEXT:
        yield data.split()  # of bytes: splits at exactly the blanks that WORD excludes
        return
    found = (m[0] for m in WORD_BYTES.finditer(data))
    while block := list(islice(found, WORDS_AT_ONCE)):
        yield block


def shingle_blocks(data: bytes, n: int) -> Iterator[list[bytes]]:
    """Every run of ``n`` words, joined by a blank; fewer words give one run of all, no word gives none."""
    carried: list[bytes] = []
    whole = True
    for block in word_blocks(data):
        words = carried + block
        if len(words) >= n:
            whole = False
            yield list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
        carried = words[max(0, len(words) - n + 1) :] if n > 1 else []
        if whole:
            carried = words
    if whole and carried:
        yield [b" ".join(carried)]


def text_tag(text: Column | str) -> Column:
    """With ``doc_id`` this names a row; rows equal in both are repeated rows and share one result."""
    return F.xxhash64(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")))


def ordered(df: DataFrame, keys: list[str], order: list[str], label: str, last: str | None = None) -> DataFrame:
    """Adds ``_nth``, the row's place from 0 within its keys; ``_last``, the latest earlier non-null value of ``last``.

    The rows are dealt by range over keys *and* order and staged, so that a key with a third of all rows spreads over many
    tasks. Each task ranks its own rows; one row per task and key carries the counts on. Equal rows are ranked arbitrarily.
    """
    names = [*keys, *order]
    cut = stage(df.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()), label)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.count("*").alias("_n")]
    carried = [F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before")]
    made = {"_nth": F.row_number().over(inside) - 1}
    if last:
        place = F.struct(*order)
        sums.append(F.max_by(last, F.when(F.col(last).isNotNull(), place)).alias("_final"))
        carried.append(F.last("_final", ignorenulls=True).over(across).alias("_carried"))
        made["_own"] = F.last(last, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    parts = cut.groupBy(*keys, "_part").agg(*sums).select(*keys, "_part", *carried)
    rows = cut.withColumns(made).alias("a")
    both = rows.join(parts.alias("b"), same_names(keys + ["_part"]), "left")
    out = both.select("a.*", "b._before", *(["b._carried"] if last else []))
    out = out.withColumn("_nth", F.col("_nth") + F.col("_before"))
    if last:
        out = out.withColumn("_last", F.coalesce("_own", "_carried")).drop("_own", "_carried")
    return out.drop("_part", "_before")


def same_names(names: list[str]) -> Column:
    matched = F.lit(True)
    for name in names:
        matched = matched & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    return matched
