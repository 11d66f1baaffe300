"""Shortest-pack-first packing over the length histogram.

Documents are cut into pieces of at most ``capacity`` tokens. Only the histogram of piece lengths
reaches the driver (at most ``capacity`` rows). Lengths are placed longest first, all pieces of a
length at once: into the open packing patterns with the most room left, whose counts are updated,
then into new ones. Pieces get their pattern's place back by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.batches import gather, map_slices, offsets_of
from hirelake.llm.tokens import encoder
from hirelake.session import staged

CAPACITY = 2048
END_ID = 1
# Rows for each bucket by which a length's rows are ranked, beside the least number of buckets.
RANKED_ROWS = 1_000_000
LEAST_BUCKETS = 64


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of every packing pattern, for counts of pieces by length.

    New patterns open only while the room left in open ones is less than what is still to be placed.
    A step works on all patterns of one room at once, so steps depend on the number of
    lengths, not of pieces.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room left
    to_place = sum(length * count for length, count in histogram.items())
    free = 0
    for length in sorted((n for n, count in histogram.items() if count), reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s in room if s), default=0)
            if space < length:
                opened = min(left, max(1, -(-(to_place - free) // capacity)))
                free += opened * capacity
                space = capacity
                room[space].append((opened, ()))
            packs = room.pop(space)
            while packs and left:
                count, pack = packs.pop()
                taken = min(count, left)
                room[space - length].append((taken, (*pack, length)))
                if taken < count:
                    packs.append((count - taken, pack))
                left -= taken
                free -= taken * length
                to_place -= taken * length
            if packs:
                room[space] = packs
    return [entry for space in sorted(room) for entry in room[space]]


class Slots:
    """For every length, which ranks go to which sequences at which offset."""

    def __init__(self, packs: list[tuple[int, tuple[int, ...]]]):
        taken: dict[int, int] = defaultdict(int)
        rows, base = [], 0
        for count, pack in packs:
            offset = 0
            for length in pack:
                rows.append((length, taken[length], base, offset))
                taken[length] += count
                offset += length
            base += count
        rows.sort()
        self.sequences = base
        columns = np.array(rows, np.int64).reshape(-1, 4).T
        self.length, self.rank, self.base, self.offset = columns
        self.key = self.length << 44 | self.rank

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        return self.base[at] + rank - self.rank[at], self.offset[at]


def cut(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text",
        capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, start, length, ids_crc32, doc_tokens and ``ids``.

    A document is the ids of its text (null: empty) and ``end_id``. Pieces are full but the last.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    if with_ids:
        schema += ", ids array<int>"

    def work(part: pa.RecordBatch) -> dict:
        ids, starts, tokens = ended(encoder(vocabulary).encode(part["text"]), end_id)
        n = -(-tokens // capacity)
        row = np.repeat(np.arange(len(n)), n)
        start = gather(np.zeros(len(n), np.int64), n) * capacity
        length = np.minimum(capacity, tokens[row] - start)
        first = starts[row] + start
        made = {id_column: part["id"].take(pa.array(row)), "start": start, "length": length,
                "doc_tokens": tokens[row],
                "ids_crc32": [zlib.crc32(ids[a:a + m]) for a, m in zip(first, length, strict=True)]}
        if with_ids:
            made["ids"] = pa.ListArray.from_arrays(pa.array(offsets_of(length), pa.int32()),
                                                   pa.array(ids.astype(np.int32)))
        return made

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return map_slices(rows, "text", schema, work)


def ended(encoded: tuple[np.ndarray, np.ndarray], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Little-endian ids with ``end_id`` after every document; each one's start and length."""
    ids, counts = encoded
    tokens = counts + 1
    ends = np.cumsum(tokens)
    made = np.full(int(ends[-1]) if len(ends) else 0, end_id, "<u4")
    inside = np.ones(len(made), bool)
    inside[ends - 1] = False
    made[inside] = ids
    return made, ends - tokens, tokens


def ranked(pieces: DataFrame, order: list[str], length: str = "length") -> DataFrame:
    """``rank`` from 0 among the rows of equal length, without gaps.

    Rows of a length are spread over buckets that grow in number with the table, numbered inside
    them, and moved by the counts of the buckets before: no window holds all rows of a hot length.
    """
    buckets = LEAST_BUCKETS + pieces.count() // RANKED_ROWS
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(length, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(length).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    moved = counts.select(F.col(length).alias("_of"), F.col("_bucket").alias("_in"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = W.partitionBy(length, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_own", F.row_number().over(own))
    on = (F.col(length) == F.col("_of")) & (F.col("_bucket") == F.col("_in"))
    return numbered.join(moved, on).withColumn("rank", F.col("_own") - 1 + F.col("_before")) \
        .drop("_own", "_of", "_in", "_before", "_bucket")


def packed(pieces: DataFrame, id_column: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of :func:`cut` with ``sequence_id`` and ``offset``.

    Sequences number from 0; inside one the offsets are gapless from 0. Ids may be null or
    repeat: pieces are told apart by their rank only, and equal pieces may change places.
    An empty table gives none. Pieces are written once, as their ranks must not change between the count
    and the placing.
    """
    kept = staged(pieces, "pieces")
    found = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Slots(patterns(found, capacity))
    schema = T.StructType([*kept.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    names = kept.columns

    def work(batches):
        for part in batches:
            sequence, offset = slots.place(part["length"].to_numpy(), part["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[part[n] for n in names], pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    return ranked(kept, [id_column, "start", "ids_crc32"]).mapInArrow(work, schema)
