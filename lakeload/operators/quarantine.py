"""Atomic batches: one bad row keeps its whole batch out, every other batch still loads.

The source applies batches in order. A batch is refused if a row breaks a rule, lacks a parent, or repeats a key inside
the batch, in the target, or in an earlier batch that was accepted. All but the last are independent of other batches and
are found set-wise. The last is settled on the colliding keys alone, which are normally none.

A batch that is NULL is a batch like any other; it applies first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeload.operators.components import components
from lakeload.operators.constraints import all_present, orphan_keys
from lakeload.operators.load import number_rows
from lakeload.operators.typed import typed_projection
from lakeload.specs import TableSpec
from lakeload.workspace import stage


#: So many contested pairs of key and batch one task walks by itself, in order; that bounds what it holds.
WALKED_AT_ONCE = 20_000


@dataclass(frozen=True)
class Quarantine:
    good: DataFrame
    bad: DataFrame
    rejected: DataFrame
    """One row per refused batch: the batch and its ``reasons``, comma-separated."""


def _same_batch(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _without(pairs: DataFrame, batches: DataFrame) -> DataFrame:
    """``pairs`` but those of ``batches``; NULL is equal to NULL."""
    return pairs.alias("p").join(batches.alias("b"), _same_batch("p.batch", "b.batch"), "left_anti")


def _key_collisions(narrow: DataFrame, spec: TableSpec, target: DataFrame | None) -> DataFrame | None:
    """(key, batch, copies, in_target, constraint) for key values that occur more than once, or None without any key.

    Counted map-side on the keys alone; then the rows that hold one of the repeated keys. Whether those few are
    broadcast is Spark's decision, by their written size.
    """
    found = []
    for number, (constraint, columns) in enumerate(spec.keys.items()):
        keyed = narrow.select(F.col(f"key_{number}").alias("key"), "batch").filter("key IS NOT NULL")
        counted = keyed.select("key.*", F.lit(1).alias("copies"), F.lit(0).alias("in_target"))
        if target is not None:
            held = target.filter(all_present(columns)).select(*_key_values(spec, columns), F.lit(0), F.lit(1))
            counted = counted.union(held)
        repeated = (
            counted.groupBy(*columns)
            .agg(F.sum("copies").alias("copies"), F.max("in_target").alias("in_target"))
            .filter("copies > 1 OR (copies = 1 AND in_target = 1)")
        )
        repeated = stage(repeated.select(*columns, "in_target"), "repeated")
        pairs = keyed.select("key.*", "batch").groupBy(*columns, "batch").agg(F.count(F.lit(1)).alias("copies"))
        label = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]))
        found.append(
            pairs.join(repeated, list(columns)).select(
                F.concat(F.lit(f"{constraint}="), label).alias("key"),
                "batch",
                "copies",
                "in_target",
                F.lit(constraint).alias("constraint"),
            )
        )
    return stage(reduce(DataFrame.union, found), "collisions") if found else None


def _key_values(spec: TableSpec, columns: Sequence[str]) -> list[Column]:
    return [spec.key_value(c).alias(c) for c in columns]


def _contested(pairs: DataFrame) -> DataFrame:
    """Pairs whose key is held by more than one batch.

    The keys are staged: a join straight on top of an aggregate of its own key is one that Spark cannot split for skew.
    """
    shared = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    return stage(pairs.join(stage(shared.select("key"), "shared"), "key", "left_semi"), "contested")


def _claims(pairs: DataFrame) -> DataFrame:
    """Per batch, which batches before it hold one of its keys: ``up``, if it is one alone; ``kind`` is root (none), single
    (one) or joint (several, or keys with more than two holders)."""
    keys = pairs.groupBy("key").agg(F.min("batch").alias("first"), F.count(F.lit(1)).alias("holders"))
    held = pairs.join(stage(keys, "first"), "key")
    before = F.when(F.col("first") < F.col("batch"), F.col("first"))
    told = held.groupBy("batch").agg(
        F.min(before).alias("up"),
        F.max(before).alias("other"),
        F.bool_or(before.isNotNull() & (F.col("holders") > 2)).alias("crowded"),
    )
    kind = F.when(F.col("up").isNull(), "root").when(~F.col("crowded") & F.expr("up = other"), "single").otherwise("joint")
    return stage(told.select("batch", kind.alias("kind"), F.when(kind == "single", F.col("up")).alias("up")), "claims")


def _settle_chains(claims: DataFrame) -> DataFrame:
    """(batch, loads) of the roots and of every batch from which single claims lead to a root.

    Such a batch loads if and only if its one earlier claimant does not, so the number of steps to the root, odd or even,
    decides. Pointer doubling: each round replaces a pointer by that of the batch it points to, so a chain of n batches takes
    about log2(n) rounds, each a join of numbers that spreads over all tasks. A batch that reached an end leaves the rounds.
    """
    kinds = claims.select(F.col("batch").alias("up"), "kind")
    now = claims.where("kind = 'single'").select("batch", "up").join(kinds, "up")
    pointers = stage(now.select("batch", "up", F.lit(True).alias("odd"), F.col("kind").alias("end")), "pointers")
    ended = [pointers.where("end <> 'single'")]
    open_ones = pointers.where("end = 'single'")
    while not open_ones.isEmpty():
        known = reduce(DataFrame.union, ended).union(open_ones)
        step = open_ones.alias("o").join(known.alias("k"), F.col("o.up") == F.col("k.batch"))
        odd = F.col("o.odd") != F.col("k.odd")
        pointers = stage(step.select("o.batch", "k.up", odd.alias("odd"), "k.end"), "pointers")
        ended.append(pointers.where("end <> 'single'"))
        open_ones = pointers.where("end = 'single'")
    settled = reduce(DataFrame.union, ended).where("end = 'root'").select("batch", (~F.col("odd")).alias("loads"))
    return settled.union(claims.where("kind = 'root'").select("batch", F.lit(True)))


def _walk(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply the batches of each component in order; returns those refused. Pairs come sorted by component and batch."""
    component, batch, taken, keys, refused = None, None, set(), [], []

    def close() -> None:
        if taken.isdisjoint(keys):
            taken.update(keys)
        elif keys:
            refused.append(batch)

    for chunk in chunks:
        columns = (chunk.column(n).to_pylist() for n in ("component", "batch", "key"))
        for now, number, key in zip(*columns, strict=True):
            if (now, number) != (component, batch):
                close()
                keys = []
                if now != component:
                    taken.clear()
                component, batch = now, number
            keys.append(key)
    close()
    yield pa.RecordBatch.from_pydict({"batch": pa.array(refused, pa.int64())})


def _settle_components(pairs: DataFrame) -> DataFrame:
    """Batches refused among ``pairs``, whose batches are numbers: batches that share no key, even through others, do not
    touch, so each connected component is walked by itself and the components spread over the tasks.

    A component is one sequence by nature: whether its last batch loads can depend on its first.
    """
    first = stage(pairs.groupBy("key").agg(F.min("batch").alias("first")), "first")
    links = pairs.join(first, "key").select(F.col("batch").alias("src"), F.col("first").alias("dst"))
    roots = components(links, "batch-components").select(F.col("node").alias("batch"), F.col("root").alias("component"))
    placed = pairs.join(roots, "batch").select("component", "batch", "key")
    dealt = placed.repartition("component").sortWithinPartitions("component", "batch")
    return dealt.mapInArrow(_walk, "batch bigint")


def _walk_at_once(pairs: DataFrame) -> DataFrame:
    """Batches refused among a bounded number of ``pairs``, walked in one task."""
    number = F.dense_rank().over(Window.orderBy(F.asc_nulls_first("batch"))).cast("bigint")
    numbered = stage(pairs.select("key", "batch", number.alias("number")), "numbered")
    one = numbered.select(F.lit(0).alias("component"), F.col("number").alias("batch"), "key")
    late = one.repartition(1).sortWithinPartitions("batch").mapInArrow(_walk, "batch bigint")
    return numbered.select("batch", "number").distinct().join(late.select(F.col("batch").alias("number")), "number").select("batch")


def _later_claims(pairs: DataFrame) -> DataFrame:
    """Batches refused because an accepted earlier batch took one of their keys; equals applying them one by one.

    Up to WALKED_AT_ONCE contested pairs are walked in one task. More are numbered in order once and settled in rounds: a
    round settles every batch that has no earlier claimant or a chain of single ones, however long, by pointer doubling, and
    refuses the others that hold a key so taken. That decides nearly all at once. Once a round decides less than half of what
    is open, which takes batches that each contest keys with several others, the rest is settled by connected component.
    """
    pairs = _contested(pairs)
    left = pairs.count()
    if left <= WALKED_AT_ONCE:
        return _walk_at_once(pairs)
    named = pairs.select(F.col("batch").isNotNull().alias("present"), "batch").distinct()
    numbers = number_rows(named, ["present", "batch"], "number")
    numbers = stage(numbers.select("batch", "number"), "numbers")
    numbered = pairs.alias("p").join(numbers.alias("n"), _same_batch("p.batch", "n.batch"))
    pairs = stage(numbered.select("key", F.col("number").alias("batch")), "open")
    refused = []
    while left > 0:
        settled = stage(_settle_chains(_claims(pairs)), "settled")
        taken = stage(pairs.join(settled.where("loads"), "batch", "left_semi").select("key").distinct(), "taken")
        late = pairs.join(taken, "key", "left_semi").join(settled.where("loads"), "batch", "left_anti")
        late = stage(late.select("batch").distinct(), "refused")
        refused.append(late)
        known = settled.where("loads").select("batch").union(late)
        pairs = _contested(pairs.join(known, "batch", "left_anti"))
        before, left = left, pairs.count()
        if left > before / 2:
            refused.append(stage(_settle_components(pairs), "refused"))
            break
    late = reduce(DataFrame.union, refused).select(F.col("batch").alias("number"))
    return numbers.join(late, "number").select("batch")


def quarantine(
    rows: DataFrame,
    spec: TableSpec,
    batch: str = "batch",
    parents: dict[str, DataFrame] | None = None,
    target: DataFrame | None = None,
    unchecked: Sequence[str] = (),
) -> Quarantine:
    """Split ``rows`` into accepted and refused batches.

    ``batch`` is any orderable column that gives the order in which batches apply; it must read the same each time, so
    stage rows whose batch comes from a scan position. ``errors`` on the rows, if there, names rules already found
    broken; otherwise the rules of ``spec`` are checked here. ``parents`` are the accepted rows of the tables referred
    to; a reference whose parent is neither there nor in ``unchecked`` is an error. ``target`` are rows already loaded.

    The rows are read twice: once for their batch, keys and errors, which are written narrow, and once to be split.
    """
    columns = [c for c in rows.columns if c != "errors"]
    lacking = [fk.parent for fk in spec.foreign_keys if fk.parent not in (parents or {}) and fk.parent not in unchecked]
    if lacking:
        raise ValueError(f"no rows are given for {', '.join(lacking)}, to which {spec.name} refers")
    checked = rows
    if "errors" not in rows.columns:
        extra = tuple(c for c in columns if c not in spec.column_names)
        checked = typed_projection(rows, spec, keep=extra).select(*columns, "errors")
    references = [fk for fk in spec.foreign_keys if fk.parent in (parents or {})]
    keys = [
        F.when(all_present(held), F.struct(*_key_values(spec, held))).alias(f"key_{number}")
        for number, held in enumerate(spec.keys.values())
    ]
    referring = sorted({c for fk in references for c in fk.columns})
    held = F.struct(*referring) if referring else F.lit(None).cast("string")
    narrow = stage(checked.select(F.col(batch).alias("batch"), "errors", *keys, held.alias("refers")), "narrow")
    verdicts = [narrow.select("batch", F.explode("errors").alias("reason")).distinct()]
    for fk in references:
        child = narrow.select("batch", "refers.*")
        orphans = orphan_keys(child, fk, parents[fk.parent], spec.ignore_case)
        orphaned = child.join(orphans, list(fk.columns), "left_semi")
        verdicts.append(orphaned.select("batch", F.lit(fk.name).alias("reason")).distinct())
    collisions = _key_collisions(narrow, spec, target)
    if collisions is not None:
        for condition, reason in (("copies > 1", "duplicate"), ("in_target = 1", "exists")):
            named = F.concat(F.lit(f"{reason}:"), F.col("constraint"))
            verdicts.append(collisions.filter(condition).select("batch", named.alias("reason")).distinct())
    verdict = reduce(DataFrame.union, verdicts)
    if collisions is not None and not collisions.isEmpty():
        verdict = stage(verdict, "verdicts")
        late = _later_claims(_without(collisions.select("key", "batch"), verdict.select("batch").distinct()))
        verdict = verdict.union(late.select("batch", F.lit("key_taken").alias("reason")))
    reasons = F.array_join(F.array_sort(F.collect_set("reason")), ",")
    rejected = stage(verdict.groupBy("batch").agg(reasons.alias("reasons")), "rejected")
    whole, refused = rows.select(*columns).alias("w"), rejected.alias("r")
    same = _same_batch(f"w.{batch}", "r.batch")
    return Quarantine(
        good=whole.join(refused, same, "left_anti").select("w.*"),
        bad=whole.join(refused, same).select("w.*", "r.reasons"),
        rejected=rejected.withColumnRenamed("batch", batch),
    )


def batch_summary(table: str, rows: DataFrame, rejected: DataFrame, batch: str = "batch") -> DataFrame:
    """Batches seen, loaded and refused, and whether the table is loaded, partial or failed (no batch at all is too)."""
    seen = rows.select(batch).distinct().select(F.lit(1).alias("seen"), F.lit(0).alias("refused"))
    refused = rejected.select(F.lit(0).alias("seen"), F.lit(1).alias("refused"))
    totals = seen.union(refused).agg(
        F.coalesce(F.sum("seen"), F.lit(0)).alias("batches"),
        F.coalesce(F.sum("refused"), F.lit(0)).alias("refused"),
    )
    none_loaded = F.col("batches") == F.col("refused")
    status = F.when(none_loaded, "failed").when(F.col("refused") == 0, "loaded").otherwise("partial")
    return totals.select(
        F.lit(table).alias("table_name"),
        "batches",
        (F.col("batches") - F.col("refused")).alias("loaded"),
        "refused",
        status.alias("status"),
    )
