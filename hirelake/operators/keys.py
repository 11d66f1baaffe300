"""Key handling shared by the joins: skew-safe lookups, first-seen rows, dense ids.

None of these puts one key's rows through a single task: first-seen and latest rows are
aggregates (combined before the shuffle), and numbering works on bounded ordinal ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions.text import col

# Ordinals per range, and ranges per block, in :func:`dense_ids`. Three times 21 bits cover BIGINT, so
# no window group there can pass 2**21 rows, however the ordinals are spread.
RANGE_BITS = 21
LEVELS = 3


def lookup(rows: DataFrame, side: DataFrame, keys: Sequence[Column | str], side_keys: Sequence[str],
           row_id: str | None = None, how: str = "left") -> DataFrame:
    """Join ``rows`` to a side with one row per key; the side's key columns are not kept.

    Reduce the side first (``distinct``, :func:`first_per`), so that a key repeated in it is combined
    before the shuffle; ``how`` may be any kind that keeps to the left rows.

    The keys' hash is a second equality, which changes no result but two partitionings:

    * A side just aggregated by its key would otherwise keep that partitioning, and AQE splits a hot
      partition only where both inputs come straight from an exchange of the join. The side is
      the smaller input, so it pays the extra exchange.
    * Rows with a null key match nothing, yet would all hash to one partition. With ``row_id`` their
      hash is taken from that instead, which spreads them.
    """
    left = [col(k) for k in keys]
    mark = F.xxhash64(*left)
    if row_id is not None:
        missing = reduce(lambda a, b: a | b, [k.isNull() for k in left])
        mark = F.when(missing, F.xxhash64(row_id)).otherwise(mark)
    names = [f"_l{i}" for i in range(len(left))]
    marked = rows.select("*", *[k.alias(n) for k, n in zip(left, names, strict=True)], mark.alias("_lh"))
    kept = [c for c in side.columns if c not in side_keys]
    others = [f"_r{i}" for i in range(len(left))]
    looked = side.select(*kept, *[F.col(k).alias(n) for k, n in zip(side_keys, others, strict=True)],
                         F.xxhash64(*side_keys).alias("_rh"))
    on = F.col("_lh") == F.col("_rh")
    for a, b in zip(names, others, strict=True):
        on = on & (F.col(a) == F.col(b))
    return marked.join(looked, on, how).drop(*names, *others, "_lh", "_rh")


def first_per(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The row with the smallest ``order`` per key, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def last_per(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def _before(counts: DataFrame, key: str, shift: int, minor: str | None = None) -> DataFrame:
    """``counts(key, [minor,] _n)`` with ``_before``, the rows of all smaller keys.

    Summed inside blocks of keys, then inside blocks of blocks, up to the whole BIGINT range, so no window holds
    more than 2**21 keys. ``key`` is an ordinal already shifted by ``shift`` bits.
    """
    earlier = (W.unboundedPreceding, -1)
    parent = F.shiftright(F.col(key), RANGE_BITS)
    rows = counts.withColumn("_up", parent)
    own = W.partitionBy("_up").orderBy(key, *[minor] * bool(minor)).rowsBetween(*earlier)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    totals = rows.groupBy(F.col("_up").alias("_key")).agg(F.sum("_n").alias("_n"))
    if shift + RANGE_BITS < LEVELS * RANGE_BITS:
        above = _before(totals, "_key", shift + RANGE_BITS)
    else:  # the two signs
        above = totals.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_key").rowsBetween(*earlier)), F.lit(0)))
    above = above.select(F.col("_key").alias("_block"), F.col("_before").alias("_above"))
    return rows.join(above, F.col("_up") == F.col("_block")).withColumn("_before", F.col("_before") + F.col("_above")) \
        .drop("_up", "_block", "_above")


def dense_ids(df: DataFrame, ordinal: str, id_col: str, after: DataFrame, minor: str | None = None) -> DataFrame:
    """Number rows ``max+1, max+2, ...`` in the order of a BIGINT ``ordinal``, unique or made so by a BIGINT ``minor``.

    ``after`` is a one-row frame holding the current maximum. Rows are numbered in parallel inside ranges of 2**21
    ordinals, or with ``minor`` of 2**21 of its values under one ordinal; a count per range gives each its offset.
    The input is read twice, so pass a stored one.
    """
    whole = F.col(ordinal).cast("bigint")
    if minor is None:
        keys, ranged = ["_range"], df.withColumn("_range", F.shiftright(whole, RANGE_BITS))
        order, shift = ordinal, RANGE_BITS
    else:
        keys = ["_range", "_part"]
        ranged = df.withColumn("_range", whole).withColumn("_part", F.shiftright(F.col(minor).cast("bigint"), RANGE_BITS))
        order, shift = minor, 0
    counts = ranged.groupBy(*keys).agg(F.count("*").alias("_n"))
    offsets = _before(counts, "_range", shift, "_part" if minor else None).drop("_n")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    new_id = F.coalesce(after.scalar(), F.lit(0)) + F.col("_before") + rank
    return ranged.join(offsets, keys).withColumn(id_col, new_id.cast("bigint")).drop(*keys, "_before")
