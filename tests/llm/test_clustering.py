"""Centroid clustering with ns-bounds against plain rounds that evaluate everything."""

import hashlib

import numpy as np
import pytest

from lakeload.llm import clustering as cl

SCHEMA = "vec_id bigint, embedding array<float>, cluster int, x string"


def embeddings(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if e is None else float(e) for e in v], 7, "clash") for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors, ids, rounds=cl.ROUNDS):
    """(cluster, distance) of each vector, by whole numbers in Python."""
    x = [[int(np.floor(64 * float(np.float32(e)))) for e in v] for v in vectors]
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), ids[i], x[i]))
    centroids = [x[i] for i in order[: cl.CENTROIDS]]

    def assign():
        out = []
        for v in x:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        near = assign()
        for c in range(len(centroids)):
            mine = [x[i] for i, (n, _) in enumerate(near) if n == c]
            if mine:
                centroids[c] = [sum(e) // len(mine) for e in zip(*mine, strict=True)]
    return assign(), centroids


def run(spark, vectors, ids=None):
    whole = cl.whole_vectors(embeddings(spark, vectors, ids))
    return cl.cluster_report(*cl.ns_kmeans(whole, cl.start_centroids(whole))).collect()


def test_equals_plain_rounds_with_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64)) * 0.2
    vectors = [*(centres[i % 6] + rng.normal(size=64) * 0.05 for i in range(150)), *[centres[0]] * 80, *[np.zeros(64)] * 3]
    vectors = [np.asarray(v, "f4") for v in vectors]
    ids = list(range(100, 100 + len(vectors)))
    expected, centroids = plain(vectors, ids)
    got = run(spark, vectors, ids)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == [(i, *e) for i, e in zip(ids, expected, strict=True)]
    inertia = {c: sum(d for n, d in expected if n == c) for c in range(16)}
    for r in got:
        assert r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values())
        digest = hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
        assert r.centroid_sha256 == digest


def test_bounds_skip_most_distances_and_change_nothing():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 64))
    x = np.repeat(centres, 200, axis=0) + rng.integers(-300, 300, (3200, 64))
    history = [centres + rng.integers(-200, 200, centres.shape)]
    state = cl.first_look(x, history[0])
    evaluated = 0
    for _ in range(6):
        history.append(history[-1] + rng.integers(-40, 40, centres.shape))
        *state, n = cl.next_look(x, *state, history, exact=False)
        evaluated += n
        assert (state[0] == cl.all_squared(x, history[-1]).argmin(axis=1)).all()
    assert evaluated < 6 * len(x)  # of 16 times as many
    *state, _ = cl.next_look(x, *state, history, exact=True)
    assert (state[1][np.arange(len(x)), state[0]] == cl.all_squared(x, history[-1]).min(axis=1)).all()


def test_total_displacement_is_what_loosens_a_bound():
    """A centroid that wandered off and came back is as if it had never moved: nothing is evaluated."""
    x = np.array([[0] * 64, [100] * 64])
    start = np.array([[1] * 64, [90] * 64])
    state = cl.first_look(x, start)
    *_, n = cl.next_look(x, *state, [start, start + 500, start - 300, start], exact=False)
    assert n == 0


def test_wide_numbers_are_exact():
    x = np.array([[cl.LARGEST - 1] * 64, [-cl.LARGEST + 1] * 64])
    far = cl.all_squared(x, x)
    assert far[0, 1] == 64 * (2 * (cl.LARGEST - 1)) ** 2 and far[0, 0] == 0


def test_rows_that_are_left_out_and_odd_ones(spark):
    good = [0.5] * 64
    vectors = [good, None, good[:63], good + [1.0], [None] + good[1:], [float("nan")] + good[1:], [float("inf")] + good[1:], [], [1e30] + good[1:], [-0.01] * 64]
    got = run(spark, vectors)
    assert sorted((r.vec_id, r.distance) for r in got) == [(0, 0), (9, 0)]
    again = run(spark, [good, good, [-0.5] * 64], [None, 4, 4])  # a null and repeated ids
    assert sorted((str(r.vec_id), r.cluster_inertia) for r in again) == [("4", 0), ("4", 0), ("None", 0)]


@pytest.mark.parametrize("vectors", [[], [None]])
def test_nothing_gives_no_row(spark, vectors):
    assert run(spark, vectors) == []
