"""Keys of new rows against all earlier runs: a Bloom filter for each run, kept beside it, tells which may hold a key.

A filter is a table of 64-bit blocks. A key's hash names one block and four of its bits, so a filter is built by one
mergeable aggregate and asked by one equality join; it has any size and is never in one place. The number of blocks is a
power of two, so filters of one size can be merged with a bitwise or and a larger one folded onto a smaller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.audit import RUN_KEYS
from lakeload.operators.constraints import all_present
from lakeload.sinks.lake import run_folder, snapshot_overwrite
from lakeload.sinks.manifest import folder_exists
from lakeload.sources.lake import all_runs
from lakeload.workspace import stage

FILTERS = "_key_filters"
#: About 16 bits a key: of the keys that a run doesn't hold some two in a hundred are asked for in vain.
KEYS_PER_BLOCK, BITS = 4, 4
SCHEMA = "block long, bits long, blocks long, processing_time string, source_database string"


def _hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*(F.col(f"`{k}`") for k in keys), F.lit(seed))


def _mask(keys: Sequence[str]) -> Column:
    """The bits of a key, from one hash: each six bits of it name a bit of the block."""
    mask, names = F.lit(0).cast("long"), _hash(keys, 1)
    for i in range(BITS):
        place = F.shiftrightunsigned(names, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def keep_key_filter(
    rows: DataFrame, keys: Sequence[str], count: int, path: str, run_time: str, source_database: str
) -> None:
    """Keep the filter of one run beside the table at ``path``; ``count`` is its number of rows, known from writing it.

    Only the key columns are read. Keys with a null are in no filter. A repeated run replaces its own.
    """
    blocks = 1 << max(0, (count // KEYS_PER_BLOCK).bit_length())
    placed = rows.filter(all_present(keys)).select(
        _hash(keys, 0).bitwiseAND(F.lit(blocks - 1).cast("long")).alias("block"), _mask(keys).alias("bits")
    )
    built = placed.groupBy("block").agg(F.bit_or("bits").alias("bits"))
    built = built.withColumn("blocks", F.lit(blocks).cast("long"))
    snapshot_overwrite(built, run_folder(f"{path}/{FILTERS}", run_time, source_database))


def kept_filters(spark: SparkSession, path: str) -> DataFrame:
    """The filters of all runs; none where none was ever kept."""
    if not folder_exists(spark, f"{path}/{FILTERS}"):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{path}/{FILTERS}")


def may_hold(new: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """(run time, source database, keys): the runs with a filter that may hold a key of ``new``; all that hold it are
    among them."""
    filters = kept_filters(new.sparkSession, path)
    sizes = [r["blocks"] for r in filters.select("blocks").distinct().collect()]  # powers of two: at most 63
    sizes = F.array(*(F.lit(s).cast("long") for s in sizes or [1]))
    wanted = new.filter(all_present(keys)).select(*keys).distinct()
    asked = wanted.select(
        *keys, _hash(keys, 0).alias("_hash"), _mask(keys).alias("_mask"), F.explode(sizes).alias("_blocks")
    )
    asked = asked.withColumn("_block", F.col("_hash").bitwiseAND(F.col("_blocks") - 1))
    met = (F.col("_block") == F.col("block")) & (F.col("_blocks") == F.col("blocks"))
    bits = F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask")
    return asked.join(filters, met & bits).select(*RUN_KEYS, *keys)


def known_keys(spark: SparkSession, table: str, path: str, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, run time, source database): keys of ``new`` that earlier runs of ``table`` hold, once for each run.

    The scan reads the key columns of the runs whose filter met a key, and of runs that have no filter; no others. The keys
    are then compared exactly. Keys with a null collide with none. ``new`` itself must not be a run of the table yet.
    """
    possible = stage(may_hold(new, keys, path), "possible-keys")
    met = {(r[0], r[1]) for r in possible.select(*RUN_KEYS).distinct().collect()}
    filtered = {(r[0], r[1]) for r in kept_filters(spark, path).select(*RUN_KEYS).distinct().collect()}
    others = {(run, source) for source, run in all_runs(spark, table)} - filtered  # empty runs too

    def of(runs) -> DataFrame:
        in_runs = F.lit(False)
        for run, source in sorted(runs):
            in_runs = in_runs | ((F.col("processing_time") == run) & (F.col("source_database") == source))
        return spark.table(table).filter(in_runs).select(*keys, *RUN_KEYS)

    wanted = new.filter(all_present(keys)).select(*keys)
    found = possible.join(of(met), [*keys, *RUN_KEYS], "left_semi").select(*keys, *RUN_KEYS)
    return found.unionAll(of(others).join(wanted, list(keys), "left_semi").distinct()) if others else found
