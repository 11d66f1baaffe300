"""Exact top-k by inner product with vector-approximation files.

Every component of every vector falls into one of 256 equal cells between the least and the greatest value of its
dimension, so a vector is one byte per dimension. Phase one scans cells only: blocks of packed cells meet groups of
queries, one product of bytes and scaled queries gives the score of the cells' centres, and half the cells' widths give a
radius that is the same for all vectors of a query; score and radius bound the true score from both sides. In a block
those stay whose upper bound reaches the k-th best lower bound, over all blocks then those that reach the k-th best of
all. Phase two joins the few that are left to their exact vectors, scores them and keeps the best k.

Of equal vectors only those with the ``k + 1`` smallest ids can be among anybody's best ``k``, so a very common vector is a
few rows in all of this.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.llm.batches import Batches, as_array
from hirelake.operators.keys import lookup
from hirelake.session import staged

SCALE = 1024
CELLS = 256
# Vectors in a block of packed cells, and queries that meet it at once.
BLOCK_ROWS = 32768
QUERY_ROWS = 512
# Queries scored together in a task.
STEP_QUERIES = 32


def scaled(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id`` and the integer vector ``v``, of vectors without null or non-finite components.

    Integers beyond BIGINT are held at its ends.
    """
    values = F.col("v")
    whole = F.transform(values, lambda x: F.floor(x.cast("double") * SCALE))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(vectors[id_column].cast("bigint").alias("vec_id"), vectors[vector_column].alias("v"))
    return rows.where(F.col("v").isNotNull() & ~bad).select("vec_id", whole.cast("array<bigint>").alias("v"))


def contenders(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the best ``k`` of a query: of each vector the ``k + 1`` smallest ids, of each id at most ``k``
    rows. Both bounds cut groups before the shuffle."""
    same = F.row_number().over(W.partitionBy("v", "vec_id").orderBy("vec_id"))
    ranked = rows.withColumn("_n", same).where(F.col("_n") <= k).drop("_n")
    ids = F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))
    return ranked.withColumn("_n", ids).where(F.col("_n") <= k + 1).drop("_n")


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def by_length(batch: pa.RecordBatch):
    """The rows of a batch by their vectors' length: (length, positions)."""
    sizes = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes):
        yield int(dims), np.flatnonzero(sizes == dims)


def ranges(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest value of every dimension, by the vectors' length: one partial row per task, combined by Spark."""
    def extremes(batches: Batches) -> Batches:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for dims, at in by_length(batch):
                x = matrix(batch["v"].take(pa.array(at)), dims)
                low, high = x.min(axis=0), x.max(axis=0)
                if dims in held:
                    low, high = np.minimum(low, held[dims][0]), np.maximum(high, held[dims][1])
                held[dims] = [low, high]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), *[pa.array([h[i].tolist() for h in held.values()], pa.list_(pa.int64())) for i in (0, 1)]],
            names=["dims", "low", "high"])

    parts = rows.where(F.size("v") > 0).select("v").mapInArrow(extremes, "dims int, low array<bigint>, high array<bigint>")
    made = parts.select("dims", F.posexplode(F.arrays_zip("low", "high")).alias("pos", "e")).groupBy("dims", "pos").agg(
        F.min("e.low").alias("low"), F.max("e.high").alias("high")).collect()
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dims in {r["dims"] for r in made}:
        own = sorted((r for r in made if r["dims"] == dims), key=lambda r: r["pos"])
        found[dims] = np.array([r["low"] for r in own], np.float64), np.array([r["high"] for r in own], np.float64)
    return found


def cells_of(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The cell of every component, one byte each."""
    step = np.where(high > low, (high - low) / CELLS, 1.0)
    return np.clip(np.floor((values.astype(np.float64) - low) / step), 0, CELLS - 1).astype(np.uint8)


def bounds(cells: np.ndarray, low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the cells' centres (vectors, queries), and each query's radius: the true score is no further off."""
    step = np.where(high > low, (high - low) / CELLS, 0.0)
    wanted = queries.astype(np.float64)
    weights = (wanted * step).T
    centre = cells.astype(np.float32) @ weights.astype(np.float32)
    base = wanted @ (low + step / 2)
    half = np.abs(wanted) @ (step / 2)
    # Rounding: of a cell's number, of the product in single precision, of the sums in double precision.
    reach = np.abs(wanted) @ np.maximum(np.abs(low), np.abs(high))
    slack = 1e-7 * (cells.shape[1] + 8) * (CELLS * np.abs(weights).sum(axis=0)) + 1e-9 * reach + half * 1e-3 + 1
    return centre.astype(np.float64) + base, half + slack


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact; beyond 64 bits in Python integers, held in BIGINT."""
    if not left.size:
        return np.zeros(len(left), np.int64)
    reach = float(np.abs(left.astype(np.float64)).max()) * float(np.abs(right.astype(np.float64)).max()) * left.shape[1]
    if reach < 2.0**62:
        return (left * right).sum(axis=1)
    wide = (left.astype(object) * right.astype(object)).sum(axis=1)
    return np.array([max(-2**63, min(2**63 - 1, s)) for s in wide], np.int64)


def scanned(ids: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray, query_ids: np.ndarray,
            queries: np.ndarray, k: int) -> tuple[list[np.ndarray], ...]:
    """Of one block: per query the positions that can be among its best ``k``, with lower and upper bound."""
    kept: tuple[list, ...] = ([], [], [], [])
    for start in range(0, len(queries), STEP_QUERIES):
        part = slice(start, start + STEP_QUERIES)
        centre, radius = bounds(cells, low, high, queries[part])
        for j, query in enumerate(query_ids[part]):
            score = np.where(ids == query, -np.inf, centre[:, j])
            least = np.partition(score, len(score) - k)[len(score) - k] - 2 * radius[j] if len(score) > k else -np.inf
            at = np.flatnonzero((score >= least) & (ids != query))
            for column, made in zip(kept, (np.full(len(at), query), at, score[at] - radius[j], score[at] + radius[j]), strict=True):
                column.append(made)
    return kept


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """Each query's ``k`` best rows: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Score is the inner product of the vectors times 1024 rounded down, held within BIGINT; ties go to the smaller id. A query meets all
    rows of its own number of components but those with its id. Vectors that are null or hold null or
    non-finite components take no part, nor do rows with a null id. Rows that share an id are each a candidate;
    as queries they count once, by their smallest vector. With fewer than ``k`` rows all are returned;
    empty tables give none. Other columns are not read.
    """
    rows = contenders(scaled(vectors, id_column, vector_column).where("vec_id IS NOT NULL"), k)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    grid = ranges(rows)
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    asked = staged(scaled(queries, id_column, vector_column).where("vec_id IS NOT NULL")
                   .groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    groups = max(1, -(-asked.count() // QUERY_ROWS))

    def index(batches: Batches) -> Batches:
        for batch in batches:
            cells: list[bytes] = [b""] * batch.num_rows
            for dims, at in by_length(batch):
                if dims:
                    made = cells_of(matrix(batch["v"].take(pa.array(at)), dims), *grid[dims])
                    for i, own in zip(at, made, strict=True):
                        cells[i] = own.tobytes()
            yield pa.RecordBatch.from_arrays([batch["row"], batch["vec_id"], pa.array(cells, pa.binary())], names=["row", "vec_id", "cells"])

    indexed = staged(rows.select("row", "vec_id", "v").mapInArrow(index, "row bigint, vec_id bigint, cells binary"), "va-file")
    # Blocks of cells meet groups of queries; no exact vector is in this shuffle.
    data = indexed.select(F.octet_length("cells").alias("dims"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "row", "vec_id", "cells")
    wanted = asked.select(F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                          F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"), "vec_id", "v")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: tuple = ([], [], [], [])
        if left.num_rows and right.num_rows:
            dims = left["dims"][0].as_py()
            low, high = grid.get(dims, (np.zeros(0), np.zeros(0)))
            cells = np.frombuffer(b"".join(left["cells"].to_pylist()), np.uint8).reshape(left.num_rows, dims)
            columns = scanned(left["vec_id"].to_numpy(), cells, low, high, right["vec_id"].to_numpy(), matrix(right["v"], dims), k)
        query, at, lower, upper = (np.concatenate([np.zeros(0, kind), *c]) for c, kind in zip(
            columns, (np.int64, np.int64, np.float64, np.float64), strict=True))
        row = left["row"].to_numpy()[at.astype(np.int64)] if left.num_rows else at
        return pa.table({"query_id": as_array(query, pa.int64()), "row": as_array(row, pa.int64()),
                         "lower": as_array(lower, pa.float64()), "upper": as_array(upper, pa.float64())})

    keys = ["dims", "block", "part"]
    near = staged(data.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(
        scan, "query_id bigint, row bigint, lower double, upper double"), "candidates")
    # The k-th best lower bound of all blocks: whoever's upper bound is below it is out.
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("lower"), "row"))
    least = near.withColumn("n", best).where(F.col("n") <= k).groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("lower")).alias("least"))
    left = lookup(near, least, ["query_id"], ["query_id"]).where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    pairs = lookup(left.select("query_id", "row"), rows.select("row", "vec_id", "v"), ["row"], ["row"], how="inner")
    pairs = lookup(pairs, asked.select(F.col("vec_id").alias("asked"), F.col("v").alias("q")), ["query_id"], ["asked"], how="inner")

    def score(batches: Batches) -> Batches:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            for dims, at in by_length(batch):
                take = pa.array(at)
                found[at] = scores(matrix(batch["v"].take(take), dims), matrix(batch["q"].take(take), dims))
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["vec_id"], pa.array(found)], names=["query_id", "vec_id", "score"])

    exact = pairs.select("query_id", "vec_id", "v", "q").mapInArrow(score, "query_id bigint, vec_id bigint, score bigint")
    first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs) WHERE rank <= 10
"""
