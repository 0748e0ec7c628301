"""Reading committed runs: as of one version, and over runs whose columns changed their types."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, StringType, StructType

from lakeload.functions.audit import INCREMENT
from lakeload.sinks.manifest import Run, manifest

# Digits before the point that a whole number of a type may have.
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
EXACT_IN_DOUBLE = ("tinyint", "smallint", "int", "float", "double")


def common_type(types: Sequence[DataType]) -> DataType:
    """The narrowest type that holds all values of ``types`` without loss; text if there is none but that."""
    by_name = {t.simpleString(): t for t in types}
    if len(by_name) == 1:
        return next(iter(by_name.values()))
    names = list(by_name)
    if all(n in DIGITS for n in names):
        return by_name[max(names, key=DIGITS.get)]
    if all(n in EXACT_IN_DOUBLE for n in names):
        return _type("double")
    decimals = [(DIGITS[n], 0) if n in DIGITS else _decimal(n) for n in names]
    if all(decimals):
        scale = max(s for _, s in decimals)
        precision = max(p - s for p, s in decimals) + scale
        if precision <= 38:
            return DecimalType(precision, scale)
    return StringType()


def _type(name: str) -> DataType:
    return StructType.fromDDL(f"a {name}")[0].dataType


def _decimal(name: str) -> tuple[int, int] | None:
    found = re.fullmatch(r"decimal\((\d+),(\d+)\)", name)
    return (int(found[1]), int(found[2])) if found else None


def common_schema(schemas: Sequence[StructType]) -> StructType:
    """Columns of all schemas in the order of the last one, then what only earlier ones have, in their common types."""
    names = list(dict.fromkeys(f.name for s in reversed(schemas) for f in s.fields))
    out = StructType()
    for name in names:
        out.add(name, common_type([s[name].dataType for s in schemas if name in s.names]))
    return out


def present_runs(runs: Sequence[Run]) -> list[Run]:
    """Each source's last full run and the increments after it."""
    last: dict[str, str] = {}
    for run in runs:
        if not run.run_time.endswith(INCREMENT):
            last[run.source_database] = max(run.run_time, last.get(run.source_database, ""))
    return [run for run in runs if run.run_time >= last.get(run.source_database, "")]


def read_runs(spark: SparkSession, path: str, runs: Sequence[Run]) -> DataFrame:
    """The rows of ``runs``, each read with the schema it was written with and cast to the common one.

    Runs of one schema are one scan. Columns that a run lacks are null in its rows. Filters on columns whose type did not
    change reach every scan.
    """
    if not runs:
        raise ValueError(f"{path} has no run to read")
    runs = sorted(runs, key=lambda run: (run.run_time, run.source_database))
    schema = common_schema([run.struct for run in runs])
    groups: dict[str, list[Run]] = {}
    for run in runs:
        groups.setdefault(run.schema, []).append(run)
    parts = []
    for alike in groups.values():
        own = alike[0].struct
        rows = spark.read.schema(own).parquet(*(f"{path}/{run.folder}" for run in alike))
        columns = [
            (F.col(f"`{f.name}`") if f.name in own.names else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
        parts.append(rows.select(*columns))
    return reduce(DataFrame.unionAll, parts)


def committed_history(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All committed runs, as of ``version`` if given."""
    return read_runs(spark, path, manifest(spark, path, version)[1])


def committed_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The present rows: of each source the last full committed run and its increments, as of ``version`` if given."""
    return read_runs(spark, path, present_runs(manifest(spark, path, version)[1]))
