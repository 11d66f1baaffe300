"""Arrow batches inside tasks: slices of bounded size, ragged arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text bytes handled at once in a task. A single longer text is a slice of its own.
SLICE_BYTES = 8 << 20

Batches = Iterator[pa.RecordBatch]


def slices(batches: Batches, column: str | int, limit: int = SLICE_BYTES) -> Batches:
    """The same rows in slices whose ``column`` holds at most ``limit`` bytes, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, n = 0, len(ends)
        while start < n:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_slices(df: DataFrame, column: str, schema: str | T.StructType,
               function: Callable[[pa.RecordBatch], dict], limit: int = SLICE_BYTES) -> DataFrame:
    """Rows made by ``function`` from slices of ``df``: a column name to array mapping per slice."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    target = arrow_schema(wanted)

    def run(batches: Batches) -> Batches:
        for part in slices(batches, column, limit):
            made = function(part)
            yield pa.RecordBatch.from_arrays(
                [as_array(made[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, wanted)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + length - 1`` of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest(rows: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hashes of ``columns``.

    A bound on the hash first leaves about four times as many, so tasks send few rows to the driver.
    """
    mark, wide = F.xxhash64(*columns), 1 << 40
    share = min(1.0, 4 * limit / max(1, rows.count()))
    return rows.where(F.pmod(mark, F.lit(wide)) < int(share * wide)) \
        .orderBy(F.pmod(mark, F.lit(wide)), *columns).limit(limit)
