"""Whitening of embeddings by the leading components of their covariance.

The covariance is never formed. A product with it is one pass over the stored vectors: every task centres
its own and returns the sum of ``c (c' q)``, for a few vectors ``q`` at once. On these products runs the
Jacobi-Davidson method for the largest eigenvalues:

1. Rayleigh-Ritz in the search space gives pairs (value, vector) with their residuals.
2. Pairs whose residual, worked out anew, is down to rounding are locked, largest first, and leave the search.
3. For each of the others the correction equation, projected off the locked and the present vectors, is solved
   by a few steps of MINRES; the corrections widen the search space. A space grown too wide is
   restarted from its best vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.batches import Batches, as_array
from hirelake.session import staged

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Entries are held here, so that they are exact as doubles.
REACH = 2**52
# Vectors packed into one stored row.
PACK_ROWS = 1024
# Rows of partial sums that go to the driver at once; of more, tasks add up groups first.
PARTIAL_ROWS = 256

INNER_STEPS = 6
BASIS_COLUMNS = 64
OUTER_STEPS = 300
EPSILON = float(np.finfo(np.float64).eps)
# A residual that stays above its limit but no longer shrinks is at its rounding if it is below this share.
SETTLED = 1e-12

Product = Callable[[np.ndarray], np.ndarray]


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and integers ``x`` of the vectors without null or non-finite entries."""
    kept = vectors.select(vectors[id_column].alias("id"), vectors[vector_column].cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists(
        "v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    entry = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-float(REACH)), F.least(F.lit(float(REACH)), c * SCALE)))
                        .cast("bigint") + SHIFT)
    return kept.where(sound).select("id", entry.alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def packed(rows: DataFrame, dims: int) -> DataFrame:
    """``x`` as binary blocks of at most :data:`PACK_ROWS` vectors."""
    def pack(batches: Batches) -> Batches:
        for batch in batches:
            x = matrix(batch["x"], dims)
            blocks = [x[i:i + PACK_ROWS].astype("<i8").tobytes() for i in range(0, len(x), PACK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["block"])

    return rows.select("x").mapInArrow(pack, "block binary")


def unpacked(batches: Batches, dims: int):
    for batch in batches:
        for block in batch["block"]:
            yield np.frombuffer(block.as_buffer(), "<i8").reshape(-1, dims)


def add(total: np.ndarray, lost: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A running sum with what rounding has lost so far."""
    made = total + more
    part = made - total
    return made, lost + ((total - (made - part)) + (more - part))


@dataclass
class Blocks:
    """Stored blocks of vectors of one length, and the number of partitions they are read in."""

    table: DataFrame
    dims: int
    parts: int

    def summed(self, shape: tuple[int, ...], partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of ``partial(block)``: compensated sums per task, of groups of tasks, of the rest."""
        dims = self.dims

        def row(total: np.ndarray, lost: np.ndarray) -> list[pa.Array]:
            return [pa.array([s.ravel()], pa.list_(pa.float64())) for s in (total, lost)]

        def combined(totals, losts) -> tuple[np.ndarray, np.ndarray]:
            total, lost = np.zeros(shape), np.zeros(shape)
            for a, b in zip(totals, losts, strict=True):
                total, lost = add(total, lost + np.reshape(b, shape), np.reshape(a, shape))
            return total, lost

        def run(batches: Batches) -> Batches:
            total, lost = np.zeros(shape), np.zeros(shape)
            for x in unpacked(batches, dims):
                total, lost = add(total, lost, partial(x))
            yield pa.RecordBatch.from_arrays(row(total, lost), names=["total", "lost"])

        def group(several: pa.Table) -> pa.Table:
            return pa.table(row(*combined(several["total"].to_pylist(), several["lost"].to_pylist())), names=["total", "lost"])

        kind = "total array<double>, lost array<double>"
        sums = self.table.mapInArrow(run, kind)
        if self.parts > PARTIAL_ROWS:
            own = F.pmod(F.spark_partition_id(), F.lit(PARTIAL_ROWS))
            sums = sums.withColumn("g", own).groupBy("g").applyInArrow(group, kind)
        rows = sums.collect()
        total, lost = combined([r["total"] for r in rows], [r["lost"] for r in rows])
        return total + lost


@dataclass
class Centre:
    """Number of vectors and their exact sums per dimension."""

    n: int
    sums: list[int]

    def exact(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``; in Python integers where 64 bits might not do."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if reach < 2**62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.exact(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of squares of ``n * x - S`` per vector, held within BIGINT."""
        exact = self.exact(x)
        if exact.dtype != object:
            most = int(np.abs(exact).max(initial=0))
            if most * most * max(1, x.shape[1]) < 2**62:
                return (exact * exact).sum(axis=1).tolist()
            exact = exact.astype(object)
        return [min(int(s), 2**63 - 1) for s in (exact * exact).sum(axis=1)]


def centre_of(blocks: Blocks) -> Centre:
    dims = blocks.dims

    def run(batches: Batches) -> Batches:
        n, sums = 0, np.zeros(dims, object)
        for x in unpacked(batches, dims):
            n, sums = n + len(x), sums + x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int64()), pa.array([[int(s) for s in sums]], pa.list_(pa.decimal128(38, 0)))], names=["n", "sums"])

    parts = blocks.table.mapInArrow(run, "n bigint, sums array<decimal(38,0)>")
    rows = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums = {r["i"]: int(r["s"]) for r in rows}
    return Centre(int(rows[0]["n"]), [sums[i] for i in range(dims)])


def off(shield: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``v`` without its part in the span of the orthonormal ``shield``; twice, for rounding."""
    for _ in range(2):
        v = v - shield @ (shield.T @ v)
    return v


def corrections(product: Product, shield: np.ndarray, values: np.ndarray, residuals: np.ndarray,
                steps: int = INNER_STEPS) -> np.ndarray:
    """Approximate solutions t of ``P (V - value) P t = -residual``, P the projection off ``shield``, all at once.

    MINRES: Lanczos vectors from the residual on, and in their span the t whose equation leaves the smallest rest.
    Every step is one product for all equations.
    """
    start = off(shield, -residuals)
    sizes = np.linalg.norm(start, axis=0)
    sizes[sizes == 0] = 1.0
    space = [start / sizes]
    diagonal, beside = [], []
    for _ in range(steps):
        w = off(shield, product(space[-1]) - space[-1] * values)
        diagonal.append((space[-1] * w).sum(axis=0))
        for _ in range(2):
            for v in space:
                w = w - v * (v * w).sum(axis=0)
        size = np.linalg.norm(w, axis=0)
        ended = size <= 16 * EPSILON * (np.abs(diagonal[-1]) + (beside[-1] if beside else 0) + np.abs(values))
        beside.append(np.where(ended, 0.0, size))
        space.append(np.where(ended, 0.0, w / np.where(size == 0, 1.0, size)))
    made = np.zeros_like(start)
    for j in range(start.shape[1]):
        n = next((i + 1 for i in range(steps) if beside[i][j] == 0), steps)
        tall = np.zeros((n + 1, n))
        for i in range(n):
            tall[i, i] = diagonal[i][j]
            tall[i + 1, i] = beside[i][j]
            if i + 1 < n:
                tall[i, i + 1] = beside[i][j]
        y = np.linalg.lstsq(tall, sizes[j] * np.eye(n + 1)[0], rcond=None)[0]
        made[:, j] = sum(y[i] * space[i][:, j] for i in range(n))
    return made


def orthonormal(v: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``v`` adds to the others; columns that add nothing but rounding go."""
    kept: list[np.ndarray] = []
    shield = np.concatenate(others, axis=1)
    for column in v.T[:, :, None]:
        size = np.linalg.norm(column)
        if not size:
            continue
        column = off(np.concatenate([shield, *kept], axis=1), column / size)
        if (size := np.linalg.norm(column)) > 1e-8:
            kept.append(off(np.concatenate([shield, *kept], axis=1), column / size))
            kept[-1] /= np.linalg.norm(kept[-1])
    return np.concatenate([np.zeros((len(v), 0)), *kept], axis=1)


def leading_pairs(product: Product, dims: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Done when every residual is at most ``max(8, sqrt(dims))`` rounding errors of the largest eigenvalue, or below
    :data:`SETTLED` of it and at rest.
    """
    drawn = np.random.default_rng(seed)
    values, locked = np.zeros(0), np.zeros((dims, 0))
    basis = orthonormal(drawn.normal(size=(dims, min(dims, 2 * k))), locked)
    image = product(basis)
    before = np.full(k, np.inf)
    for _ in range(OUTER_STEPS):
        ritz, y = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        ritz, y = ritz[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        left = k - len(values)
        scale = max([*values, *np.abs(ritz)])
        limit = max(8.0, np.sqrt(dims)) * EPSILON * scale
        rest = off(locked, image[:, :left] - basis[:, :left] * ritz[:left])
        sizes = np.linalg.norm(rest, axis=0)
        resting = (sizes <= SETTLED * scale) & (sizes > before[-len(sizes):] / 2)
        n = int(np.argmin(np.append((sizes <= limit) | resting, False)))
        if n:
            fresh = product(basis[:, :n])
            again = np.linalg.norm(off(locked, fresh - basis[:, :n] * ritz[:n]), axis=0)
            n = int(np.argmin(np.append((again <= 2 * limit) | (resting[:n] & (again <= SETTLED * scale)), False)))
        before = np.concatenate([np.full(k - left, np.inf), sizes])
        if n:
            values, locked = np.append(values, ritz[:n]), np.concatenate([locked, basis[:, :n]], axis=1)
            basis, image, ritz, rest = basis[:, n:], image[:, n:], ritz[n:], rest[:, n:]
            if len(values) >= k:
                break
        left = k - len(values)
        if basis.shape[1] + left > BASIS_COLUMNS:
            basis, image = basis[:, :left + k], image[:, :left + k]
        more = corrections(product, np.concatenate([locked, basis[:, :left]], axis=1), ritz[:left], rest)
        more = orthonormal(more, locked, basis)
        if not more.shape[1]:  # nothing new in the corrections: any direction not yet searched
            free = dims - locked.shape[1] - basis.shape[1]
            more = orthonormal(drawn.normal(size=(dims, min(left, free))), locked, basis)
        if more.shape[1]:
            basis, image = np.concatenate([basis, more], axis=1), np.concatenate([image, product(more)], axis=1)
    else:
        raise ArithmeticError(f"{k - len(values)} of {k} residuals are above rounding after {OUTER_STEPS} steps")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


@dataclass
class Whitening:
    """A fitted whitening: centre, eigenvalues above rounding, their vectors, the covariance's trace."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def shares(self) -> np.ndarray:
        """Each component's share of the trace."""
        return self.values / self.trace if self.trace else self.values

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fitted(blocks: Blocks, k: int = COMPONENTS) -> Whitening:
    centre, dims = centre_of(blocks), blocks.dims
    n = centre.n

    def product(q: np.ndarray) -> np.ndarray:
        def partial(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ q)

        return blocks.summed(q.shape, partial) / n

    trace = float(blocks.summed((1,), lambda x: np.array([np.square(centre.centred(x)).sum()]))[0]) / n
    values, vectors = leading_pairs(product, dims, min(k, dims)) if trace > 0 else (np.zeros(0), np.zeros((dims, 0)))
    real = values > dims * EPSILON * trace
    made = Whitening(centre, values[real], vectors[:, real], trace)
    p = int(real.sum())
    if p:
        def squares(x: np.ndarray) -> np.ndarray:
            w = made.of(x)
            return w.T @ w

        made.identity_error = float(np.abs(blocks.summed((p, p), squares) / n - np.eye(p)).max())
    return made


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
             k: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: the id column, ``component`` from 1, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``.

    An entry c counts as ``floor(1024 c) + 100000``, held within 2**52. Rows whose vector is null, empty, or holds null or
    non-finite entries go, as do vectors of another length than the most frequent one (the smaller on a tie). Every
    other row counts, also with a null or repeated id. ``n`` is their number, ``deviation`` the exact sum of squares of
    ``n x - S`` (held within BIGINT), ``explained`` the component's share of the covariance's trace. Components without
    variance beyond rounding have none to be divided by and give no rows; so there are fewer than ``k`` where vectors are short, few or equal.
    Components of equal eigenvalue are any orthogonal ones. Other columns are not read.
    """
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = (f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    rows = staged(whole_vectors(vectors, id_column, vector_column), "vectors")
    length = F.size("x").alias("dims")
    usual = rows.groupBy(length).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "dims").limit(1).collect()
    if not usual:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    dims = usual[0]["dims"]
    rows = rows.where(F.size("x") == dims)
    blocks = staged(packed(rows, dims), "vector-blocks")
    fit = fitted(Blocks(blocks, dims, blocks.rdd.getNumPartitions()), k)
    p = len(fit.values)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = matrix(batch["x"], dims)
            m = len(x)
            each = np.repeat(np.arange(m), p)
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(pa.array(each)), as_array(np.tile(np.arange(1, p + 1), m), pa.int32()),
                as_array(np.full(m * p, fit.centre.n), pa.int64()),
                pa.array(fit.centre.deviations(x), pa.int64()).take(pa.array(each)),
                as_array(fit.of(x).ravel(), pa.float64()), as_array(np.tile(fit.shares, m), pa.float64()),
                as_array(np.full(m * p, fit.identity_error), pa.float64())],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
