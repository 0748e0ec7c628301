"""Whitening of embeddings by their leading principal components, found by a Jacobi-Davidson iteration.

The covariance is never formed: each step multiplies it with a few vectors, which is one pass over the staged vectors, each
task adding up its own share. The driver holds only vectors of one embedding's length. A step expands a search space by the
solution of the projected correction equation of every sought pair, found by MINRES with all pairs in lock-step, so that one
inner step of all of them is one pass. Pairs whose residual has reached double precision are locked and projected out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.llm.common import table
from lakeload.workspace import stage

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Largest size of an entry, so that whole numbers and their sums stay exact; and bytes of vectors packed into one row.
LARGEST, PACKED_BYTES = float(1 << 30), 1 << 22
#: Inner steps of a correction equation at most, the share of a residual at which it is solved, and outer steps at most.
INNER, INNER_SHARE, OUTER = 4, 0.1, 500
BLOCKS = "ids array<bigint>, x binary"


def whole_vectors(embeddings: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): floor(scale * entry) + shift for each entry. Left out are null vectors, those with an entry that is null,
    not finite or beyond LARGEST in size, and those that don't have the most frequent length (of equal counts the longest)."""
    fits = lambda v: F.coalesce(F.abs(v.cast("double")) < LARGEST, F.lit(False))  # noqa: E731  NaN is above all
    kept = embeddings.where((F.size("embedding") > 0) & F.forall("embedding", fits))
    lengths = kept.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    length = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * float(scale)) + shift)
    kept = kept.where(F.size("embedding") == (length.d if length else 0))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("x"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, x = batch.column("vec_id"), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
        rows = max(1, PACKED_BYTES // (8 * x.shape[1]))
        for at in range(0, len(x), rows):
            part = ids.slice(at, rows)
            packed = pa.array([x[at : at + rows].astype("<i8").tobytes()], pa.binary())
            offsets = pa.array([0, len(part)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, part), packed], ["ids", "x"])


def _unpacked(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for packed in batch.column("x"):
            yield np.frombuffer(packed.as_buffer(), "<i8").reshape(-1, d)


class Covariance:
    """The covariance of packed vectors (BLOCKS) of length ``d``, as a product with a few vectors at a time."""

    def __init__(self, blocks: DataFrame, d: int):
        self.blocks, self.d, self.passes = blocks.select("x"), d, 0

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = 0, np.zeros(d, "i8")
            for x in _unpacked(batches, d):
                n, sums = n + len(x), sums + x.sum(axis=0)
            if n:
                yield pa.RecordBatch.from_pydict({"at": np.arange(d, dtype="i4"), "n": np.full(d, n), "s": sums})

        part = self.blocks.mapInArrow(count, "at int, n bigint, s bigint")
        exact = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
        totals = sorted(part.groupBy("at").agg(F.sum("n").alias("n"), exact).collect())  # one row for each dimension
        self.n = totals[0].n if totals else 0
        self.sums = [int(t.s) for t in totals]
        self.mean = np.array([s / self.n for s in self.sums])

    def trace(self) -> float:
        d, mean = self.d, self.mean

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(float(np.square(x - mean).sum()) for x in _unpacked(batches, d))
            yield pa.RecordBatch.from_pydict({"s": [total]})

        self.passes += 1
        return (self.blocks.mapInArrow(add, "s double").agg(F.sum("s")).first()[0] or 0.0) / self.n

    def __matmul__(self, u: np.ndarray) -> np.ndarray:
        d, mean = self.d, self.mean

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(u.shape)
            for x in _unpacked(batches, d):
                centred = x - mean
                total += centred.T @ (centred @ u)
            yield pa.RecordBatch.from_pydict({"at": np.arange(total.size, dtype="i4"), "s": total.ravel()})

        self.passes += 1
        sums = self.blocks.mapInArrow(multiply, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
        product = np.zeros(u.size)
        for r in sums:  # as many rows as the product has entries
            product[r["at"]] = r.s
        return product.reshape(u.shape) / self.n


def minres(product: Callable, rhs: np.ndarray, steps: int, share: float) -> np.ndarray:
    """Approximate solutions of one symmetric system for each column of ``rhs``, all in lock-step.

    ``product`` takes and gives all columns. A column stops changing once its residual is down to ``share`` of its start."""
    beta = np.linalg.norm(rhs, axis=0)
    start, floor = beta.copy(), np.finfo("f8").tiny
    q, q_old = rhs / np.maximum(beta, floor), np.zeros_like(rhs)
    w, w_old, x = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    left, c, s, c_old, s_old = beta.copy(), -1.0 + 0 * beta, 0 * beta, -1.0 + 0 * beta, 0 * beta
    beta = 0 * beta
    active = start > 0
    for _ in range(steps):
        v = product(q) - beta * q_old
        alpha = (q * v).sum(axis=0)
        v -= alpha * q
        following = np.linalg.norm(v, axis=0)
        # the column of the tridiagonal matrix under the two rotations before, then this step's rotation
        epsilon, delta_bar = s_old * beta, -c_old * beta
        delta, gamma_bar = c * delta_bar + s * alpha, s * delta_bar - c * alpha
        gamma = np.maximum(np.hypot(gamma_bar, following), floor)
        c_old, s_old, c, s = c, s, gamma_bar / gamma, following / gamma
        w, w_old = (q - delta * w - epsilon * w_old) / gamma, w
        x = np.where(active, x + c * left * w, x)
        left = s * left
        active &= (np.abs(left) > share * start) & (following > floor)
        if not active.any():
            break
        q, q_old, beta = v / np.maximum(following, floor), q, following
    return x


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The directions of ``new`` that ``against`` and each other lack, orthonormal to double precision."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), np.finfo("f8").tiny)
    for _ in range(2):
        for basis in against:
            new = new - basis @ (basis.T @ new)
    kept = [b for b in against]
    out = []
    for column in new.T:
        before = np.linalg.norm(column)
        for _ in range(2):
            for basis in kept:
                column = column - basis @ (basis.T @ column)
        norm = np.linalg.norm(column)
        if norm > 1e-10 and norm > 1e-8 * before:
            column = column / norm
            out.append(column)
            kept.append(column[:, None])
    return np.stack(out, axis=1) if out else np.empty((len(new), 0))


def jacobi_davidson(a, d: int, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, their unit vectors and the norms of their residuals.

    ``a @ u`` is the product of a symmetric matrix with the columns of ``u``. A pair is locked once its residual is at the
    rounding of a product, a few units of the last place of the largest eigenvalue."""
    count = min(count, d)
    limit = min(d, max(4 * count, count + 8))
    basis = _orthonormal(np.random.default_rng(seed).normal(size=(d, count)))
    image = a @ basis
    locked, values, norms = np.empty((d, 0)), [], []
    for _ in range(OUTER):
        theta, s = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, s = theta[order], s[:, order]
        basis, image = basis @ s, image @ s
        residual = image - basis * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        precision = 8 * np.finfo("f8").eps * np.sqrt(d) * max([abs(v) for v in values] + [abs(theta[0]), np.finfo("f8").tiny])
        done = 0  # lock in order, so that no smaller pair is taken before a larger one
        while done < len(theta) and len(values) + done < count and size[done] <= precision:
            done += 1
        locked = np.concatenate([locked, basis[:, :done]], axis=1)
        values, norms = values + list(theta[:done]), norms + list(size[:done])
        basis, image, theta, residual = basis[:, done:], image[:, done:], theta[done:], residual[:, done:]
        if len(values) == count:
            return np.array(values), locked, np.array(norms)
        sought = min(count, basis.shape[1])  # pairs beyond the last one sought speed up the last ones
        if basis.shape[1] + sought > limit:
            keep = min(basis.shape[1], sought + 4)
            basis, image = basis[:, :keep], image[:, :keep]
        u, shift = basis[:, :sought], theta[:sought]
        outside = np.concatenate([locked, u], axis=1)

        def project(t: np.ndarray, outside=outside) -> np.ndarray:
            return t - outside @ (outside.T @ t)

        def corrected(t: np.ndarray, project=project, shift=shift) -> np.ndarray:
            t = project(t)
            return project(a @ t - t * shift)

        t = minres(corrected, -project(residual[:, :sought]), INNER, INNER_SHARE)
        new = _orthonormal(t, locked, basis)
        if not new.shape[1]:  # an invariant space was found; go on outside it
            new = _orthonormal(np.random.default_rng(seed + len(values)).normal(size=(d, count)), locked, basis)
        if not new.shape[1] and done == 0:
            break
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, a @ new], axis=1)
    raise ArithmeticError(f"{count - len(values)} components did not reach double precision in {OUTER} steps")


def components_of(covariance: Covariance, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues and eigenvectors of the leading components that the vectors spread along at all.

    An eigenvalue that is zero but for rounding has no whitened projection; its component and those after it are left out."""
    values, vectors, _ = jacobi_davidson(covariance, covariance.d, count)
    least = covariance.d * np.finfo("f8").eps * max(values[0], 0.0)
    met = int(np.argmin(np.append(values > least, False)))
    return values[:met], vectors[:, :met]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2 for each row, exact; null if it doesn't fit a long."""
    far = max(abs(n * int(e) - s) for bound in (x.max(axis=0), x.min(axis=0)) for e, s in zip(bound, sums, strict=True))
    if far * far * x.shape[1] < 1 << 63:
        t = n * x - np.array(sums, "i8")
        return np.einsum("ij,ij->i", t, t).tolist()
    t = n * x.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (t * t).sum(axis=1)]


def whiten(
    blocks: DataFrame, covariance: Covariance, values: np.ndarray, vectors: np.ndarray
) -> DataFrame:
    """(vec_id, component, deviation, whitened) for each packed vector and component, without a shuffle."""
    n, sums, mean, d, k = covariance.n, covariance.sums, covariance.mean, covariance.d, len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in enumerate(_unpacked([batch], d)):
                projected = (x - mean) @ vectors / np.sqrt(values)
                columns = [
                    batch.column("ids")[row].values.take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(x))),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(projected.ravel()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened"])

    return blocks.mapInArrow(project, "vec_id bigint, component int, deviation bigint, whitened double")


def identity_error(blocks: DataFrame, covariance: Covariance, values: np.ndarray, vectors: np.ndarray) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity: measured, in one pass."""
    mean, d, k = covariance.mean, covariance.d, len(values)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for x in _unpacked(batches, d):
            projected = (x - mean) @ vectors / np.sqrt(values)
            total, sums = total + projected.T @ projected, sums + projected.sum(axis=0)
        entries = np.concatenate([total.ravel(), sums])
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(entries), dtype="i4"), "s": entries})

    part = blocks.select("x").mapInArrow(multiply, "at int, s double")
    sums = np.zeros(k * k + k)
    for r in part.groupBy("at").agg(F.sum("s").alias("s")).collect():
        sums[r["at"]] = r.s
    middle = sums[k * k :] / covariance.n
    return float(np.abs(sums[: k * k].reshape(k, k) / covariance.n - np.outer(middle, middle) - np.eye(k)).max())


def whitened_embeddings(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and component up to ``count``.

    The vectors are those of ``whole_vectors``, all of which the components are fitted on. Components along which nothing
    varies are left out, so equal vectors, a single one or none give no row; fewer dimensions or vectors than ``count`` give
    fewer components. Repeated rows count and are returned as often as they occur; a null vec_id is kept. A deviation beyond a
    long is null. Columns other than vec_id and embedding are left out.
    """
    vectors = whole_vectors(embeddings)
    blocks = stage(vectors.mapInArrow(_pack, BLOCKS), "whitening")
    first = vectors.select(F.size("x").alias("d")).first()
    columns = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if first is None:
        return embeddings.sparkSession.createDataFrame([], columns)
    covariance = Covariance(blocks, first.d)
    values, directions = components_of(covariance, count)
    if not len(values):
        return embeddings.sparkSession.createDataFrame([], columns)
    trace, error = covariance.trace(), identity_error(blocks, covariance, values, directions)
    explained = F.get(F.array(*(F.lit(float(v / trace)) for v in values)), F.col("component") - 1)
    return whiten(blocks, covariance, values, directions).select(
        "vec_id", "component", F.lit(covariance.n).cast("bigint").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitened_embeddings(table(spark, sf, "embeddings"))
