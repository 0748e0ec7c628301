"""Key and reference checks. Spark does not enforce either on Parquet, so each is a job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.specs import ForeignKey, TableSpec, load_order
from lakeload.workspace import stage


def all_present(columns: Sequence[str]):
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
    return condition


def pk_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their count. Counted map-side first, so a hot key is no hot task."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def unique_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """As ``pk_duplicates``, but NULLs do not collide."""
    return pk_duplicates(df.filter(all_present(key)), key)


def orphan_keys(child: DataFrame, fk: ForeignKey, parent: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Distinct child key values without a parent, named as the child columns and written to the shared folder.

    Only the key columns are read and shuffled, and equal keys merge before the shuffle. Normally few or none are left,
    so that the child rows themselves need no shuffle when they meet this table: Catalyst broadcasts it if its written
    size is under the session's threshold, and sort-merges otherwise.
    """
    text = [c for c, kind in child.dtypes if kind == "string"] if ignore_case else []

    def same(column: str):
        held, referred = F.col(column), F.col(f"parent_{column}")
        return F.lower(held) == F.lower(referred) if column in text else held == referred

    values = child.select(*fk.columns).filter(all_present(fk.columns)).distinct()
    named = [F.col(p).alias(f"parent_{c}") for c, p in zip(fk.columns, fk.parent_columns, strict=True)]
    return stage(values.join(parent.select(*named), [same(c) for c in fk.columns], "left_anti"), "orphans")


def _with_key_in(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, keys.columns, "left_semi").select(*df.columns)


def _without_key_in(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not among ``keys``; a NULL key is among none."""
    return df.join(keys, keys.columns, "left_anti").select(*df.columns)


def fk_violations(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """Child rows whose parent is missing; a NULL in the key refers to nothing and is no violation."""
    return _with_key_in(child, orphan_keys(child, fk, parent))


def fk_clean(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """Child rows without a violation."""
    return _without_key_in(child, orphan_keys(child, fk, parent))


def cascade_delete(
    tables: dict[str, DataFrame], specs: Sequence[TableSpec], table: str, keys: DataFrame
) -> dict[str, DataFrame]:
    """What is left of every table once the rows of ``table`` named by ``keys`` are deleted.

    The rows that go are followed downwards by key, parents first whatever the order of ``specs``, and every child loses
    those that refer to them; ``keys`` holds columns of ``table``. A table that refers to itself is followed until no
    more of its rows go: one round per level of its hierarchy. Tables that refer to each other in a circle are refused.
    """
    dead = {table: [keys]}
    left = dict(tables)
    gone: dict[str, DataFrame] = {}
    for spec in load_order(specs):
        if spec.name not in tables:
            continue
        lost = list(dead.get(spec.name, []))
        lost += [_referring(fk, gone[fk.parent]) for fk in spec.foreign_keys if fk.parent in gone and fk.parent != spec.name]
        if not lost:
            continue
        loops = [fk for fk in spec.foreign_keys if fk.parent == spec.name]
        rows, removed = tables[spec.name], []
        while lost:
            held = stage(reduce(DataFrame.union, [_with_key_in(rows, k) for k in lost]), "gone")
            if removed and held.isEmpty():
                break
            removed.append(held)
            for k in lost:
                rows = _without_key_in(rows, k)
            lost = [_referring(fk, held) for fk in loops]
        gone[spec.name], left[spec.name] = reduce(DataFrame.union, removed), rows
    if table not in gone:
        raise ValueError(f"no spec for {table}")
    return left


def _referring(fk: ForeignKey, parents: DataFrame) -> DataFrame:
    """The values by which child rows refer to ``parents``, named as the child's columns."""
    named = [F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns, strict=True)]
    return stage(parents.select(*named).distinct(), "deleted")
