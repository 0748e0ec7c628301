"""Atomic batches against a client that applies them one by one."""

import random

import pytest

from lakeload.operators import quarantine as module
from lakeload.operators.quarantine import batch_summary, quarantine
from lakeload.specs import Column, ForeignKey, TableSpec

SPEC = TableSpec(
    "child",
    (Column("id", "int", True), Column("code", "varchar(4)"), Column("parent", "int")),
    primary_key=("id",),
    unique=(("code",),),
    foreign_keys=(ForeignKey(("parent",), "parent", ("p",)),),
    checks={"not_13": "id <> 13"},
)


def one_by_one(batches, parents, target):
    """The sequential client: a batch goes in whole or not at all."""
    ids, codes, accepted = {r[0] for r in target}, {r[1] for r in target if r[1]}, []
    for number, rows in batches:
        new_ids, new_codes, ok = set(ids), set(codes), True
        for id_, code, parent in rows:
            if id_ is None or id_ == 13 or id_ in new_ids or (code and (len(code) > 4 or code in new_codes)):
                ok = False
            if parent is not None and parent not in parents:
                ok = False
            new_ids.add(id_)
            if code:
                new_codes.add(code)
        if ok:
            ids, codes = new_ids, new_codes
            accepted.append(number)
    return accepted


def frames(spark, batches, parents, target):
    flat = [(*row, number) for number, rows in batches for row in rows]
    return (
        spark.createDataFrame(flat, "id int, code string, parent int, batch int"),
        {"parent": spark.createDataFrame([(p,) for p in parents], "p int")},
        spark.createDataFrame(target, "id int, code string, parent int"),
    )


@pytest.fixture(params=[0, 20_000], ids=["in rounds", "walked at once"])
def way(request, monkeypatch):
    monkeypatch.setattr(module, "WALKED_AT_ONCE", request.param)


@pytest.mark.parametrize("seed", range(2))
def test_random_batches(spark, way, seed):
    rng = random.Random(seed)
    parents, target = [1, 2, 3], [(90, "t90", 1), (91, None, None)]
    batches = [
        (
            n,
            [
                (
                    rng.choice([None, 13, 90, *range(14, 75), *range(100, 400)]),
                    rng.choice([None, None, f"c{rng.randrange(60)}", "t90", "toolong"]),
                    rng.choice([None, 1, 2, 3, 9 if rng.random() < 0.2 else 1]),
                )
                for _ in range(rng.randrange(1, 4))
            ],
        )
        for n in range(60)
    ]
    rows, parent_frames, target_frame = frames(spark, batches, parents, target)
    split = quarantine(rows, SPEC, parents=parent_frames, target=target_frame)
    expected = one_by_one(batches, parents, target)
    assert sorted(r["batch"] for r in split.good.select("batch").distinct().collect()) == expected
    assert split.good.count() + split.bad.count() == rows.count()
    summary = batch_summary("child", rows, split.rejected).first()
    assert (summary["batches"], summary["loaded"]) == (60, len(expected))


def test_chain_of_overlapping_batches(spark, way):
    """Every batch repeats a key of the one before: each second one is refused."""
    batches = [(n, [(100 + n, None, None), (101 + n, None, None)]) for n in range(13)]
    rows, parents, target = frames(spark, batches, [1], [(1, None, None)])
    split = quarantine(rows, SPEC, parents=parents, target=target)
    assert sorted(r["batch"] for r in split.good.select("batch").distinct().collect()) == list(range(0, 13, 2))
    assert {r["reasons"] for r in split.rejected.collect()} == {"key_taken"}


def test_reasons_and_status(spark):
    batches = [
        (0, [(1, "a", None), (2, "b", None)]),
        (1, [(3, "toolong", None), (4, "c", None)]),
        (2, [(4, None, 9)]),
        (3, [(5, "d", None), (5, "e", None)]),
        (4, [(90, None, None)]),
        (5, [(1, None, None)]),
        (6, [(3, None, None)]),
        (7, [(13, None, None)]),
    ]
    rows, parents, target = frames(spark, batches, [1], [(90, None, None)])
    split = quarantine(rows, SPEC, parents=parents, target=target)
    assert {r["batch"]: r["reasons"] for r in split.rejected.collect()} == {
        1: "code:length",
        2: "foreign_key:parent",
        3: "duplicate:primary_key",
        4: "exists:primary_key",
        5: "key_taken",
        7: "check:not_13",
    }
    assert batch_summary("child", rows, split.rejected).first()["status"] == "partial"


def test_case_insensitive_keys(spark):
    columns = (Column("code", "varchar(4)", True),)
    binary = TableSpec("t", columns, primary_key=("code",))
    folded = TableSpec("t", columns, primary_key=("code",), ignore_case=True)
    rows = spark.createDataFrame([("ab", 0), ("AB", 1)], "code string, batch int")
    assert quarantine(rows, binary).good.count() == 2
    assert quarantine(rows, folded).good.collect()[0]["code"] == "ab"
    refers = {"foreign_keys": (ForeignKey(("code",), "p", ("c",)),)}
    parents = {"p": spark.createDataFrame([("AB",)], "c string")}
    assert quarantine(rows, TableSpec("t", columns, **refers), parents=parents).good.count() == 1
    assert quarantine(rows, TableSpec("t", columns, ignore_case=True, **refers), parents=parents).good.count() == 2


def test_many_chains_are_settled_each_by_itself(spark, way):
    """Forty chains of thirteen batches, mixed in order of application; and one batch that touches several chains."""
    batches = [(40 * n + c, [(1000 * c + n, None, None), (1000 * c + n + 1, None, None)]) for n in range(13) for c in range(2, 42)]
    batches.append((9999, [(2000, None, None), (3001, None, None), (99_000, None, None)]))
    rows, parents, target = frames(spark, batches, [1], [(1, None, None)])
    split = quarantine(rows, SPEC, parents=parents, target=target)
    expected = one_by_one(batches, [1], [(1, None, None)])
    assert sorted(r["batch"] for r in split.good.select("batch").distinct().collect()) == expected
    assert len(expected) == 40 * 7


def test_trees_joints_and_crowded_keys(spark, way):
    """Chains that fork and meet, batches that contest several others, and a key that many claim."""
    rng = random.Random(7)
    batches = []
    for n in range(120):
        keys = {1000 + n}
        if n and rng.random() < 0.9:
            keys.add(1000 + n - rng.choice([1, 1, 1, 2, 7]))
        if rng.random() < 0.1:
            keys.add(rng.choice([77, 78]))
        batches.append((n, [(k, None, None) for k in sorted(keys)]))
    rows, parents, target = frames(spark, batches, [1], [(1, None, None)])
    split = quarantine(rows, SPEC, parents=parents, target=target)
    expected = one_by_one(batches, [1], [(1, None, None)])
    assert sorted(r["batch"] for r in split.good.select("batch").distinct().collect()) == expected


def test_rows_without_a_batch_are_one_batch_that_comes_first(spark):
    spec = TableSpec("t", (Column("k", "int", True), Column("v", "int")), primary_key=("k",), checks={"small": "v < 10"})
    rows = spark.createDataFrame([(None, 1, 99), (None, 2, 1), (7, 3, 99), (8, 4, 1)], "batch int, k int, v int")
    split = quarantine(rows, spec)
    assert [r["k"] for r in split.good.collect()] == [4]
    assert sorted((r["k"], r["reasons"]) for r in split.bad.collect()) == [(k, "check:small") for k in (1, 2, 3)]
    rows = spark.createDataFrame([(None, 1, 1), (None, 2, 1), (7, 2, 2), (8, 4, 1)], "batch int, k int, v int")
    split = quarantine(rows, spec)
    assert sorted(r["k"] for r in split.good.collect()) == [1, 2, 4]
    assert [(r["batch"], r["reasons"]) for r in split.rejected.collect()] == [(7, "key_taken")]


def test_batches_may_be_structs(spark):
    rows = spark.createDataFrame([(0, 5, 1), (0, 9, 2), (1, 0, 2), (1, 0, 3), (1, 1, 3), (2, 0, 2)], "p int, q int, id int")
    rows = rows.selectExpr("struct(p, q) AS batch", "id")
    spec = TableSpec("t", (Column("id", "int", True),), primary_key=("id",))
    split = quarantine(rows, spec)
    assert sorted(r["id"] for r in split.good.collect()) == [1, 2, 3]
    assert {r["reasons"] for r in split.rejected.collect()} == {"key_taken"}


def test_a_reference_is_not_silently_left_unchecked(spark):
    rows, parents, _ = frames(spark, [(0, [(1, None, 9)])], [1], [(1, None, None)])
    with pytest.raises(ValueError, match="parent"):
        quarantine(rows, SPEC)
    assert quarantine(rows, SPEC, unchecked=["parent"]).good.count() == 1
    assert quarantine(rows, SPEC, parents=parents).good.count() == 0


def test_no_rows(spark):
    rows, parents, target = frames(spark, [(0, [(1, None, 1)])], [1], [(1, None, None)])
    split = quarantine(rows.limit(0), SPEC, parents=parents, target=target)
    assert split.good.isEmpty() and split.bad.isEmpty() and split.rejected.isEmpty()
    assert batch_summary("child", rows.limit(0), split.rejected).first()["status"] == "failed"
