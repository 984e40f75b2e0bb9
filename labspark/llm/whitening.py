"""Whitening of embeddings: leading covariance eigenvectors by a block Jacobi-Davidson method.

The covariance is never formed. Every product of it with a few vectors is one Spark job over the fit list (each
distinct integer vector once): centre a block of rows, multiply, multiply back, add up. The driver holds vectors
of the embedding's dimension only. A search space is widened by corrections t of
(1 - QQ')(V - theta)(1 - QQ') t = -residual, each solved roughly by MINRES; the solvers of all unfinished components
run in step, so one job serves an inner step of all. Rayleigh-Ritz on the space gives the next estimates;
leading pairs whose residual has reached double precision are locked and left out of the space, which is cut
to its best directions when it grows too large. At the end the locked pairs are multiplied anew and checked.

Centring is exact: entries are integers, the nearest integer to the mean is taken off first and the remaining
fraction (S - n * m) / n after that.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are rows
whose length is not the most frequent one (the greater of equals). Entries beyond a long saturate.
Directions without variance are no components, so there may be fewer than asked for, and equal vectors alone give no rows.
Repeated rows each get their result. Equal eigenvalues: any orthonormal basis, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.shared import written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Outer rounds, inner steps of a round, and directions kept in the search space for each component.
ROUNDS = 60
INNER = 12
SPACE_FACTOR = 6
#: Residuals and least eigenvalues are measured against the largest eigenvalue by this many roundings a root of dimension.
ROUNDINGS = 48
#: Tasks that add up the sums of the other tasks.
SUMMERS = 16
#: Rows of a task handled at once.
ROWS = 2048
EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """n, S per dimension, unit eigenvectors (one per column), eigenvalues, trace and the jobs it took."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    products: int
    residual: float
    identity_error: float = 0.0


def usable(vector: Column) -> Column:
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & plain


def integer_vectors(rows: DataFrame, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The usable rows with ``x``, the entries as floor(scale * c) + shift; all of one length."""
    most = float((1 << 63) - 1024 - shift)
    kept = rows.where(usable(F.col(vector))).withColumn("x", F.transform(vector, lambda c: (F.floor(F.greatest(
        F.least(c.cast("double") * scale, F.lit(most)), F.lit(-most))).cast("long") + shift)))
    sizes = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head()
    return kept.where(F.size("x") == (sizes["size"] if sizes else 0))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class CentredProducts:
    """Products of the fit list's covariance with a few vectors, each one job."""

    def __init__(self, fit: DataFrame, n: int, sums: list[int]):
        self.fit, self.n, self.dims = fit, n, len(sums)
        self.base = np.array([round(s / n) for s in sums], np.int64)
        self.fraction = np.array([(s - n * int(m)) / n for s, m in zip(sums, self.base, strict=True)])
        self.jobs = 0

    def _summed(self, block, width: int) -> np.ndarray:
        """The sum over all rows of block(centred rows), a (dims or width) x width matrix, added up by Spark."""
        base, fraction, dims = self.base, self.fraction, self.dims

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                x = matrix(batch.column(0), dims)
                for at in range(0, len(x), ROWS):
                    part = block((x[at:at + ROWS] - base).astype(float) - fraction)
                    total = part if total is None else total + part
            if total is not None:  # one row per task
                task = TaskContext.get().partitionId()
                yield packed(task % SUMMERS, task, total.ravel())

        def add(parts: pa.Table) -> pa.Table:
            parts = parts.sort_by("task")  # the same order of additions whenever it runs
            total = sum(np.frombuffer(p.as_py()) for p in parts["part"])
            return pa.Table.from_batches([packed(parts["slot"][0].as_py(), 0, total)])

        def packed(slot: int, task: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([task], pa.int32()),
                                               pa.array([total.tobytes()], pa.binary())], ["slot", "task", "part"])

        self.jobs += 1
        schema = "slot int, task int, part binary"
        sums = self.fit.select("x").mapInArrow(work, schema).groupBy("slot").applyInArrow(add, schema)
        parts = sorted(sums.collect())  # at most SUMMERS small matrices, whatever the number of rows
        return sum(np.frombuffer(bytes(r["part"])) for r in parts).reshape(-1, width) / self.n

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return self._summed(lambda c: c.T @ (c @ vectors), vectors.shape[1])

    def trace(self) -> float:
        return float(self._summed(lambda c: np.array([[np.einsum("ij,ij->", c, c)]]), 1)[0, 0])

    def covariance_of(self, projection: np.ndarray) -> np.ndarray:
        """The covariance of the projected rows, centred by their own mean."""
        k = projection.shape[1]

        def block(c: np.ndarray) -> np.ndarray:
            w = np.c_[c @ projection, np.ones(len(c))]
            return w.T @ w

        moments = self._summed(block, k + 1)
        mean = moments[:k, k]
        return moments[:k, :k] - np.outer(mean, mean)


def orthonormal(vectors: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the vectors add to a space; directions that add nothing are left out."""
    kept = np.empty((len(vectors), 0))
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not np.isfinite(size) or size == 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - against @ (against.T @ v)
            v = v - kept @ (kept.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            kept = np.c_[kept, v]
    return kept


def corrections(product, space: np.ndarray, theta: np.ndarray, residuals: np.ndarray, steps: int) -> np.ndarray:
    """MINRES in step for (1 - QQ')(V - theta_j)(1 - QQ') t_j = -r_j, Q being ``space``; one product a step."""
    def project(v: np.ndarray) -> np.ndarray:
        v = v - space @ (space.T @ v)
        return v - space @ (space.T @ v)

    v = project(-residuals)
    beta = np.linalg.norm(v, axis=0)
    beta[beta == 0] = 1.0
    v = v / beta
    eta, last = beta.copy(), np.zeros_like(v)
    size = beta.copy()
    c_old = c = np.ones_like(beta)
    s_old = s = np.zeros_like(beta)
    w_old, w = np.zeros_like(v), np.zeros_like(v)
    t = np.zeros_like(v)
    lanczos = np.zeros_like(beta)
    active = np.ones(len(beta), bool)
    for _ in range(steps):
        u = project(product(v) - v * theta)
        alpha = (v * u).sum(0)
        u = u - v * alpha - last * lanczos
        following = np.linalg.norm(u, axis=0)
        rho1_ = c * alpha - c_old * s * lanczos
        rho1 = np.hypot(rho1_, following)
        rho2 = s * alpha + c_old * c * lanczos
        rho3 = s_old * lanczos
        safe = np.where(rho1 == 0, 1.0, rho1)
        c_old, s_old = c, s
        c, s = rho1_ / safe, following / safe
        w_old, w = w, (v - w_old * rho3 - w * rho2) / safe
        t = t + np.where(active, c * eta, 0.0) * w
        eta = -s * eta
        active &= (np.abs(eta) > 1e-3 * size) & (following > 1e-14 * np.abs(theta).max())
        if not active.any():
            break
        last, lanczos = v, following
        v = u / np.where(following == 0, 1.0, following)
    return project(t)


def leading_pairs(product, dims: int, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenpairs of a symmetric non-negative operator given by its products with blocks of vectors.

    Returns unit vectors (columns), eigenvalues by falling size and the largest residual relative to the
    largest eigenvalue. Directions whose eigenvalue is zero to double precision are left out.
    """
    count = min(count, dims)
    rng = np.random.default_rng(seed)
    locked, locked_product = np.empty((dims, 0)), np.empty((dims, 0))
    space = orthonormal(rng.standard_normal((dims, min(dims, 2 * count))), locked)
    image = product(space)
    most = min(dims, SPACE_FACTOR * count)
    limit, scale = ROUNDINGS * EPS * np.sqrt(dims), 0.0
    for _ in range(ROUNDS):
        values, turn = np.linalg.eigh((lambda h: (h + h.T) / 2)(space.T @ image))
        values, turn = values[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        scale = max(scale, float(values[0]) if len(values) else 0.0)
        whole = locked.shape[1] + space.shape[1] >= dims
        wanted = min(count - locked.shape[1], space.shape[1])
        residuals = image[:, :wanted] - space[:, :wanted] * values[:wanted]
        residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        done = 0
        while done < wanted and (whole or sizes[done] <= limit * scale):
            done += 1
        locked, locked_product = np.c_[locked, space[:, :done]], np.c_[locked_product, image[:, :done]]
        space, image = space[:, done:], image[:, done:]
        if locked.shape[1] >= count or not space.shape[1]:
            # multiply the locked vectors anew; go on with those that rounding has moved
            locked = np.linalg.qr(locked)[0]
            locked_product = product(locked)
            values, turn = np.linalg.eigh((lambda h: (h + h.T) / 2)(locked.T @ locked_product))
            values, turn = values[::-1], turn[:, ::-1]
            locked, locked_product = locked @ turn, locked_product @ turn
            error = float(np.linalg.norm(locked_product - locked * values, axis=0).max()) / max(scale, 1e-300)
            if error <= 4 * limit or whole:
                break
            locked, space = np.empty((dims, 0)), orthonormal(np.c_[locked, space], np.empty((dims, 0)))
            locked_product, image = np.empty((dims, 0)), product(space)
            continue
        if space.shape[1] + count > most:
            best = max(2 * (count - locked.shape[1]), most // 2)
            space, image = space[:, :best], image[:, :best]
        open_ = slice(done, wanted)
        theta = values[open_]
        around = np.linalg.qr(np.c_[locked, space[:, :wanted - done]])[0]
        found = corrections(product, around, theta, residuals[:, open_], INNER)
        fresh = orthonormal(np.c_[found, residuals[:, open_]], np.c_[locked, space])[:, :wanted - done]
        if not fresh.shape[1]:
            fresh = orthonormal(rng.standard_normal((dims, count)), np.c_[locked, space])
        space, image = np.c_[space, fresh], np.c_[image, product(fresh)]
    else:
        raise ArithmeticError(f"{ROUNDS} rounds did not bring all residuals to double precision")
    real = values > 4 * limit * scale
    return locked[:, real], values[real], error


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors in column ``x``; None if there are no rows."""
    distinct = written(rows.select("x").distinct(), "fit-list")
    dims = (distinct.select(F.size("x").alias("d")).head() or [0])[0]
    if not dims:
        return None
    found = distinct.agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col("x")[i].cast("decimal(28,0)")).alias(f"s{i}") for i in range(dims)]).head()
    sums = [int(s) for s in found[1:]]
    product = CentredProducts(distinct, found["n"], sums)
    trace = product.trace()
    if trace <= 0:
        return Whitening(found["n"], sums, np.empty((dims, 0)), np.empty(0), 0.0, product.jobs, 0.0)
    vectors, values, residual = leading_pairs(product, dims, components)
    model = Whitening(found["n"], sums, vectors, values, trace, product.jobs, residual)
    spread = product.covariance_of(vectors / np.sqrt(values))
    model.identity_error = float(np.abs(spread - np.eye(len(values))).max(initial=0.0))
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n * x - S) ** 2 per row; in longs where they hold it."""
    base = np.array([round(s / n) for s in sums], np.int64)
    rest = [s - n * int(m) for s, m in zip(sums, base, strict=True)]
    away = x - base
    most = n * int(np.abs(away).max(initial=0)) + max(map(abs, rest))
    if most * most * len(sums) < 1 << 63:
        z = away * n - np.array(rest, np.int64)
        return np.einsum("ij,ij->i", z, z).tolist()
    return [sum((n * int(a) - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in away]


def transform(rows: DataFrame, model: Whitening, keep: list[str]) -> DataFrame:
    """Per row: the columns of ``keep``, deviation (decimal) and whitened, an array with one number per component."""
    columns = rows.select(*keep, "x")
    kept = [f for f in columns.schema.fields if f.name != "x"]
    dims, n, sums = len(model.sums), model.n, model.sums
    base = np.array([round(s / n) for s in sums], np.int64)
    fraction = np.array([(s - n * int(m)) / n for s, m in zip(sums, base, strict=True)])
    projection = model.vectors / np.sqrt(model.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column(len(kept)), dims)
                white = np.ascontiguousarray(((x - base).astype(float) - fraction) @ projection)
                offsets = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(kept)], pa.array([str(d) for d in deviations(x, n, sums)]),
                     pa.ListArray.from_arrays(offsets, white.ravel())], [*keep, "deviation", "whitened"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["deviation string, whitened array<double>"])
    return columns.mapInArrow(work, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Other columns of ``rows`` are left out. See the module for nulls, lengths and ties.
    """
    vectors = integer_vectors(rows.select(key, vector), vector)
    model = fit(vectors, components)
    if model is None or not len(model.values):
        return vectors.select(key, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast(
            "decimal(38,0)").alias("deviation"), *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]).limit(0)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    out = transform(vectors, model, [key]).select(key, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(
        key, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
