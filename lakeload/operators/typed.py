"""Text or loosely typed columns to declared types, with every broken row rule named."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from lakeload.specs import Column, TableSpec

DATE_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$"


def _convert(raw: SparkColumn, raw_type: DataType, column: Column) -> SparkColumn:
    if column.spark_type == "string":
        value = raw.cast("string")
        if column.is_char:
            return F.rtrim(value)
        if column.max_length:  # only blanks at the end may go; a longer text is an error and stays whole
            fits = F.length(F.rtrim(value)) <= column.max_length
            return F.when(fits, F.left(value, F.lit(column.max_length))).otherwise(value)
        return value
    if raw_type.simpleString() == column.spark_type:
        return raw
    converted = raw.try_cast(column.spark_type)
    if column.spark_type == "date" and isinstance(raw_type, StringType):
        return F.when(raw.rlike(DATE_TEXT), converted)  # a bare year is a date to Spark, not to the source
    return converted


def _column_errors(raw: SparkColumn, converted: SparkColumn, column: Column, ignore_case: bool) -> list[SparkColumn]:
    broken = {}
    if column.required:
        broken["null"] = raw.isNull()
    if column.max_length:
        broken["length"] = F.length(F.rtrim(raw.cast("string"))) > column.max_length
    elif column.allowed:
        text, allowed = raw.cast("string"), column.allowed
        if ignore_case:
            text, allowed = F.lower(text), [a.lower() for a in allowed]
        broken["enum"] = ~text.isin(allowed)
    elif column.spark_type != "string":
        broken["type"] = raw.isNotNull() & converted.isNull()
    return [F.when(condition, f"{column.name}:{rule}").otherwise("") for rule, condition in broken.items()]


def _named(errors: list[SparkColumn]) -> SparkColumn:
    """The errors that are not empty; without a lambda, so that the projection stays in generated code."""
    if not errors:
        return F.array().cast("array<string>")
    return F.array_remove(F.array(*errors), "")


def typed_projection(
    df: DataFrame, spec: TableSpec, keep: tuple[str, ...] = (), raw: str | None = None
) -> DataFrame:
    """The columns of ``spec`` in their declared types, ``keep`` unchanged, and ``errors``: the rules each row breaks.

    One projection, no shuffle. A value that does not convert becomes NULL and is named in ``errors``; nothing is
    dropped here. ``raw`` names one more column, in which a row with errors keeps the texts that did not convert, by
    column name, so that it can be repaired; it is NULL for all other rows.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    converted = {c.name: _convert(F.col(f"`{c.name}`"), types[c.name], c) for c in spec.columns}
    column_errors = [
        e
        for c in spec.columns
        for e in _column_errors(F.col(f"`{c.name}`"), converted[c.name], c, spec.ignore_case)
    ]
    kept = []
    if raw:
        lost = [
            F.when(F.col(f"`{n}`").isNotNull() & v.isNull(), F.struct(F.lit(n), F.col(f"`{n}`").cast("string")))
            for n, v in converted.items()
        ]
        texts = F.array_compact(F.array(*lost))
        kept = [F.when(F.size(texts) > 0, F.map_from_entries(texts)).alias(raw)]
    typed = df.select(
        *[v.alias(n) for n, v in converted.items()], *keep, *kept, _named(column_errors).alias("_column_errors")
    )
    checks = [F.when(~F.expr(rule), f"check:{name}").otherwise("") for name, rule in spec.checks.items()]
    return typed.withColumn("errors", F.concat("_column_errors", _named(checks))).drop("_column_errors")


def row_rule_violations(df: DataFrame, spec: TableSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per broken rule: the primary key, ``keep`` and the rule."""
    typed = typed_projection(df, spec, keep)
    return typed.select(*spec.primary_key, *keep, F.explode("errors").alias("rule"))
