"""Centroid clustering with ns-bounds: Lloyd's rounds in whole numbers that skip the distances that can't matter.

Each vector keeps, for every centroid, the exact squared distance from when it was last evaluated and the round of that. A
centroid may have wandered since, but no further than the norm of its *total* displacement between the two rounds, which is
never more than the sum of its drifts round by round. All earlier centroids are kept, rounds x centroids of them, so that
norm is known. A centroid whose distance, lowered by it, is above the own one, raised by it, is not looked at. Whatever
fails this is evaluated anew in whole numbers, so the outcome is that of evaluating everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.llm.common import table
from lakeload.workspace import stage

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Largest size of an entry in whole numbers, so that a squared distance always fits a long.
LARGEST = 1 << 26
#: Up to this size doubles hold every sum of squares exactly.
EXACT_IN_DOUBLES = 1 << 21
#: What rounding can do to a bound, of its size and at least.
SLACK, LEAST_SLACK = 1e-12, 1e-9
STATE = "vec_id bigint, x array<int>, cluster int, squares array<bigint>, seen array<int>"


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) for the vectors with exactly ``dimensions`` entries, none null, not finite or beyond LARGEST / scale;
    each entry is floor(scale * entry). Null vectors and other lengths are left out, and so are all other columns."""
    bound = float(LARGEST // scale)
    fits = lambda v: F.coalesce(F.abs(v.cast("double")) < bound, F.lit(False))  # noqa: E731  NaN is above all
    kept = embeddings.where((F.size("embedding") == dimensions) & F.forall("embedding", fits))
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * float(scale)).cast("int"))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("x"))


def start_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the least hex sha256 of ``seed:vec_id``, in this order; all if there are fewer.

    Rows of one vec_id are told apart by their entries; a null vec_id comes last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(key.alias("key"), "vec_id", "x").orderBy(F.asc_nulls_last("key"), "vec_id", "x").limit(k)
    found = [r.x for r in first.collect()]
    return np.array(found, "i8").reshape(len(found), -1) if found else np.empty((0, DIMENSIONS), "i8")


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` and rows of ``c``, row by row."""
    d = x.astype("i8") - c
    return np.einsum("ij,ij->i", d, d)


def all_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every row of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT_IN_DOUBLES and x.shape[1] <= 256:
        xd, cd = x.astype("f8"), c.astype("f8")  # whole numbers, none above 2^53 in between
        made = (xd * xd).sum(axis=1)[:, None] - 2.0 * (xd @ cd.T) + (cd * cd).sum(axis=1)
        return made.astype("i8")
    return np.stack([squared(x, row) for row in c], axis=1)


def first_look(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    squares = all_squared(x, centroids)
    return squares.argmin(axis=1).astype("i4"), squares, np.zeros(squares.shape, "i4")  # of equal ones the first


def next_look(
    x: np.ndarray, cluster: np.ndarray, squares: np.ndarray, seen: np.ndarray, history: list[np.ndarray], exact: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The state of the vectors under the last of ``history``, and how many distances were evaluated.

    ``exact``: also evaluate each vector's own distance, which otherwise is only done where its bounds fail."""
    now, k = len(history) - 1, len(history[-1])
    moved = np.stack([np.sqrt(squared(history[-1], old).astype("f8")) for old in history])
    cluster, squares, seen = cluster.copy(), squares.copy(), seen.copy()
    rows, numbers = np.arange(len(x)), np.arange(k)

    def failing(which: np.ndarray) -> np.ndarray:
        """Of the rows ``which``: the centroids that may be as near as the row's own."""
        reach, drift = np.sqrt(squares[which].astype("f8")), moved[seen[which], numbers]
        own = np.arange(len(which)), cluster[which]
        upper, lower = (reach[own] + drift[own])[:, None], reach - drift
        out = ~(upper * (1 + SLACK) + LEAST_SLACK < lower * (1 - SLACK) - LEAST_SLACK)
        out[own] = False
        return out

    open_rows = rows if exact else np.flatnonzero(failing(rows).any(axis=1))
    mine = cluster[open_rows]
    squares[open_rows, mine], seen[open_rows, mine] = squared(x[open_rows], history[-1][mine]), now
    fails = failing(open_rows)
    at, number = np.nonzero(fails)
    squares[open_rows[at], number], seen[open_rows[at], number] = squared(x[open_rows[at]], history[-1][number]), now
    fails[np.arange(len(open_rows)), mine] = True
    looked_at = np.where(fails, squares[open_rows], np.iinfo("i8").max)
    cluster[open_rows] = looked_at.argmin(axis=1)
    return cluster, squares, seen, len(open_rows) + len(at)


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype="i4"))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))


def _look(history: list[np.ndarray], exact: bool) -> Callable:
    k, width = history[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), width, "i4")
            if len(history) == 1:
                cluster, squares, seen = first_look(x, history[0])
            else:
                before = batch.column("cluster").to_numpy()
                held = _matrix(batch.column("squares"), k, "i8"), _matrix(batch.column("seen"), k, "i4")
                cluster, squares, seen, _ = next_look(x, before, *held, history, exact)
            columns = [batch.column("vec_id"), batch.column("x"), pa.array(cluster, pa.int32())]
            columns += [_lists(squares, pa.int64()), _lists(seen, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "cluster", "squares", "seen"])

    return run


def _sums(k: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((k, width), "i8"), np.zeros(k, "i8")
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            np.add.at(sums, cluster, _matrix(batch.column("x"), width, "i8"))
            sizes += np.bincount(cluster, minlength=k)
        met = np.flatnonzero(sizes)
        made = [pa.array(met, pa.int32()), pa.array(sizes[met], pa.int64()), _lists(sums[met], pa.int64())]
        yield pa.RecordBatch.from_arrays(made, ["cluster", "n", "sums"])

    return run


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floored mean of its vectors; one without any stays. Every task sums its own vectors first."""
    k, width = centroids.shape
    part = state.select("cluster", "x").mapInArrow(_sums(k, width), "cluster int, n bigint, sums array<bigint>")
    entries = part.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    totals = entries.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    made = centroids.copy()
    for r in totals.collect():  # k * width rows
        made[r.cluster, r["at"]] = r.s // r.n
    return made


def ns_kmeans(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, distance) per row of ``vectors``, and the final centroids.

    ``vectors`` has vec_id and x, whole numbers of one length up to LARGEST in size. Each of ``rounds`` rounds assigns every
    vector to the nearest centroid, of equal ones the first, and moves the centroids; then all are assigned once more.
    ``distance`` is the squared one. Every round is one pass without a shuffle, written to the shared folder, and a sum that
    each task makes of its own vectors. Repeated rows are vectors of their own. No row gives no row.
    """
    history, state = [centroids], vectors
    if not len(centroids):
        return vectors.select("*", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids
    for _ in range(rounds):
        state = stage(state.mapInArrow(_look(list(history), False), STATE), "clusters")
        history.append(moved_centroids(state, history[-1]))
    state = stage(state.mapInArrow(_look(list(history), True), STATE), "clusters")
    return state.select("vec_id", "x", "cluster", F.get("squares", F.col("cluster")).alias("distance")), history[-1]


def _of_cluster(values: list, kind: str):
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster"))


def cluster_report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` (vec_id, cluster, distance) with the inertia of its cluster and of all, and the centroid's sha256.

    An inertia beyond a long is null. Sums of one row for each cluster go through the driver."""
    sums = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("s"))
    inertia = {r.cluster: r.s for r in sums.collect()}
    own = [inertia.get(c, 0) for c in range(len(centroids))]
    total = None if None in own else sum(own)
    digests = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return assigned.select(
        "vec_id", "cluster", "distance",
        _of_cluster(own or [None], "bigint").alias("cluster_inertia"),
        F.lit(total if total is None or total < 1 << 63 else None).cast("bigint").alias("inertia"),
        _of_cluster(digests or [None], "string").alias("centroid_sha256"),
    )


def op13_centroid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf, "embeddings"))
    assigned, centroids = ns_kmeans(vectors, start_centroids(vectors))
    return cluster_report(assigned, centroids)


def _sql() -> str:
    """Plain rounds, each evaluating everything."""
    nearest = """a{r} AS (SELECT vec_id, x, arg_min(number, (d, number)) AS cluster, min(d) AS distance, row_id FROM (
    SELECT v.row_id, v.vec_id, v.x, c.number, list_sum(list_transform(range(1, 65),
        lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d FROM v, c{r} c) GROUP BY row_id, vec_id, x)"""
    moved = """c{n} AS (SELECT c.number, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
        SELECT cluster, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i)
    GROUP BY cluster) m ON m.cluster = c.number)"""
    steps = []
    for r in range(ROUNDS):
        steps += [nearest.format(r=r), moved.format(r=r, n=r + 1)]
    steps.append(nearest.format(r=ROUNDS))
    return f"""
WITH v AS (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding,
    lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, vec_id, x) - 1 AS number, x FROM v
    QUALIFY number < 16),
{", ".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.number = cluster
"""


SQL13 = _sql()
