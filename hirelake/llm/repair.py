"""Token-id files under a Re-Pair grammar per shard, with random access.

Pass by pass the frequent neighbouring pairs of a shard become nonterminals. A limit falls from level to
level; a pass takes all pairs that reach it, and of overlapping occurrences the more frequent pair wins. At the
last level a rule still pays: it costs two symbols and a length, an occurrence saves one symbol. Passes go on
there until no pair is left that often; from the second on they count the pairs of new symbols and those an
overlap held back: all of a pair's occurrences begin in one pass, so a pair once counted as rare stays rare.
Pairs across the end of a document stay, so every document begins with a symbol of its own. A shard holds its rules,
the expansion length of every rule, the symbols, and per document the id, symbols and tokens: any token
range of a document is found by summing expansion lengths, without expanding what lies before. Symbols
take as many bits as the shard's largest one needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.llm import files
from hirelake.llm.batches import as_array, gather, offsets_of, slices
from hirelake.llm.packing import END_ID, ended
from hirelake.llm.tokens import encoder
from hirelake.session import staged, staging_path

SHARD_TOKENS = 1 << 20
# The fewest occurrences that a rule is made for, and the limits of the passes: the first one, and how they fall.
FREQUENT = 4
FIRST_LEVEL = 1024
LEVEL_STEP = 4
# From this level up pairs are counted by a hash first; below, most would pass.
HASH_LEVEL = 64
HASH_BITS = 17
MAGIC = b"RPG2"
HEADER = struct.Struct("<4sIIIIBB")


def compress(ids: np.ndarray, counts: np.ndarray, first_rule: int,
             frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols, symbols per document) of documents' ids in a row.

    Rule ``i`` stands behind symbol ``first_rule + i`` and holds two earlier symbols.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    rules: list[np.ndarray] = []
    used = first_rule
    level = max(frequent, FIRST_LEVEL)
    fresh = None
    while len(symbols) > 1:
        at = likely(symbols, last, level) if fresh is None else fresh
        pos, group, pairs, back = chosen(symbols, at, level, frequent)
        if not len(pos):
            if level == frequent:
                break
            level = max(frequent, level // LEVEL_STEP)
            continue
        symbols[pos] = group.astype(np.uint32) + np.uint32(used)
        last[pos] = last[pos + 1]
        keep = np.ones(len(symbols), bool)
        keep[pos + 1] = False
        symbols, last = symbols[keep], last[keep]
        rules.append(pairs)
        used += len(pairs)
        if level > frequent:
            level = max(frequent, level // LEVEL_STEP)
            continue
        made = pos - np.arange(len(pos))
        back -= np.searchsorted(pos, back)  # where they begin now; beside a new symbol its pair is meant
        fresh = np.concatenate([made - 1, made, back])
        fresh.sort()
        fresh = fresh[(fresh >= 0) & (fresh < len(symbols) - 1) & (np.diff(fresh, prepend=-2) > 0)]
        fresh = fresh[~last[fresh]]
    ends = np.flatnonzero(last) + 1
    own = np.zeros(len(counts), np.int64)
    own[counts > 0] = np.diff(np.concatenate([[0], ends]))
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), symbols, own


def likely(symbols: np.ndarray, last: np.ndarray, level: int) -> np.ndarray:
    """Where pairs begin that may come ``level`` times: no pair is more frequent than its hash's slot."""
    if level < HASH_LEVEL:
        return np.flatnonzero(~last[:-1])
    slots = (symbols[:-1] * np.uint32(2654435761) + symbols[1:] * np.uint32(2246822519)) >> np.uint32(32 - HASH_BITS)
    slots = slots.astype(np.intp)
    return np.flatnonzero((np.bincount(slots, minlength=1 << HASH_BITS) >= level).take(slots) & ~last[:-1])


def by_pair(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each pair that begins at ``at``, sorted as pairs are, and where it begins."""
    width, room = int(symbols.max()).bit_length(), len(symbols).bit_length()
    left, right = symbols[at].astype(np.uint64), symbols[at + 1].astype(np.uint64)
    if 2 * width + room > 64:
        keys = left << np.uint64(32) | right
        order = np.argsort(keys)
        return keys[order], at[order]
    # Pair and place in one number: sorted as such, several times faster than by an order.
    keys = (left << np.uint64(width) | right) << np.uint64(room) | at.astype(np.uint64)
    keys.sort()
    places = (keys & np.uint64((1 << room) - 1)).view(np.int64)
    keys >>= np.uint64(room)
    return keys, places


def chosen(symbols: np.ndarray, at: np.ndarray, level: int,
           frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, number of the pair at each, pairs) to replace, of the pairs that begin at ``at``, and
    where pairs begin that come ``level`` times and are held back.

    A pair has to come ``level`` times, and ``frequent`` times without those that lie over a better one's.
    """
    keys, places = by_pair(symbols, at)
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    sizes = np.diff(np.append(heads, len(keys)))
    often = sizes >= level
    first, places, sizes = places[heads[often]], places[np.repeat(often, sizes)], sizes[often]
    # Ranks by frequency tell pairs apart from here on.
    by_size = np.argsort(sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[by_size] = np.arange(1, len(sizes) + 1)
    first = first[by_size]
    both = places << 32 | np.repeat(rank, sizes)
    both.sort()
    places = pos = both >> 32
    own = both & 0xFFFFFFFF
    beside = pos[1:] == pos[:-1] + 1
    wins = np.ones(len(pos), bool)
    wins[1:] &= ~beside | (own[1:] >= own[:-1])
    wins[:-1] &= ~beside | (own[:-1] >= own[1:])
    at, own = np.flatnonzero(wins), own[wins] - 1
    pos = places[at]
    # Neighbours left over are a run of one symbol: every second one, from the left.
    start = np.append(True, pos[1:] != pos[:-1] + 1)[:len(pos)]
    run = np.maximum.accumulate(np.where(start, np.arange(len(pos)), 0))
    taken = (np.arange(len(pos)) - run) % 2 == 0
    at, own = at[taken], own[taken]
    pays = np.bincount(own, minlength=len(first)) >= frequent
    taken = pays[own]
    at, own = at[taken], own[taken]
    first = first[pays]
    back = np.ones(len(places), bool)
    back[at] = False
    return places[at], (np.cumsum(pays) - 1)[own], np.stack([symbols[first], symbols[first + 1]], axis=1), places[back]


def stages(rules: np.ndarray, first_rule: int) -> Iterator[tuple[int, int]]:
    """Spans of rules, in order, none of which holds a symbol of its own span."""
    highest = np.maximum.accumulate(rules.max(axis=1)) if len(rules) else np.zeros(0, np.int64)
    start = 0
    while start < len(rules):
        stop = int(np.searchsorted(highest, first_rule + start))
        yield start, stop
        start = stop


def wide(values: np.ndarray, bits: int) -> bytes:
    """Numbers of so many bits: the low 16 of each, then every further bit of all."""
    return values.astype("<u2").tobytes() + b"".join(
        np.packbits((values >> np.uint32(bit)) & np.uint32(1)).tobytes() for bit in range(16, bits))


class Shard:
    """A shard's bytes, decoded as needed."""

    def __init__(self, data: bytes):
        magic, self.first_rule, n_rules, n_symbols, n_docs, bits, size_bytes = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no shard of token ids")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            made = np.frombuffer(data, kind, n, at)
            at += made.nbytes
            return made

        def take_wide(n: int) -> np.ndarray:
            made = take("<u2", n).astype(np.int64)
            for bit in range(16, bits):
                made |= np.unpackbits(take("u1", (n + 7) // 8), count=n).astype(np.int64) << bit
            return made

        self.rules = take_wide(2 * n_rules).reshape(-1, 2)
        self.rule_sizes = take(f"<u{size_bytes}", n_rules)
        self.symbols = take_wide(n_symbols)
        self.doc_symbols, self.doc_tokens = take("<u4", n_docs), take("<u4", n_docs)
        self.doc_ids, self.doc_null = take("<i8", n_docs), take("u1", n_docs).astype(bool)

    @staticmethod
    def pack(ids: np.ndarray, counts: np.ndarray, doc_ids: np.ndarray, doc_null: np.ndarray,
             first_rule: int) -> bytes:
        rules, symbols, own = compress(ids, counts, first_rule)
        sizes = expansion_sizes(rules.astype(np.int64), first_rule)[first_rule:]
        bits = max(16, (first_rule + len(rules) - 1).bit_length())
        size_bytes = next(n for n in (1, 2, 4) if sizes.max(initial=0) < 1 << 8 * n)
        return b"".join([
            HEADER.pack(MAGIC, first_rule, len(rules), len(symbols), len(counts), bits, size_bytes),
            wide(rules.reshape(-1), bits), sizes.astype(f"<u{size_bytes}").tobytes(),
            wide(symbols, bits), own.astype("<u4").tobytes(), counts.astype("<u4").tobytes(),
            doc_ids.astype("<i8").tobytes(), doc_null.astype("u1").tobytes()])

    @cached_property
    def sizes(self) -> np.ndarray:
        """Tokens of every symbol."""
        return np.concatenate([np.ones(self.first_rule, np.int64), self.rule_sizes.astype(np.int64)])

    @cached_property
    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' ids in a row, and where each one's begin."""
        starts = offsets_of(self.sizes)
        flat = np.empty(int(starts[-1]), "<u4")
        flat[:self.first_rule] = np.arange(self.first_rule)
        for first, after in stages(self.rules, self.first_rule):
            target = starts[self.first_rule + first:self.first_rule + after]
            for symbol in self.rules[first:after].T:
                n = self.sizes[symbol]
                flat[gather(target, n)] = flat[gather(starts[symbol], n)]
                target = target + n
        return flat, starts

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, starts = self.expansions
        symbols = symbols.astype(np.int64)
        return flat[gather(starts[symbols], self.sizes[symbols])]

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens ``start`` to ``stop`` of the shard's ``i``-th document."""
        a = int(self.doc_symbols[:i].sum())
        own = self.symbols[a:a + int(self.doc_symbols[i])]
        stop = int(self.doc_tokens[i]) if stop is None else min(stop, int(self.doc_tokens[i]))
        if start >= stop:
            return np.zeros(0, "<u4")
        ends = np.cumsum(self.sizes[own])
        first, after = np.searchsorted(ends, [start, stop - 1], side="right")
        before = int(ends[first - 1]) if first else 0
        return self.expand(own[first:after + 1])[start - before:stop - before]


def expansion_sizes(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Tokens of every symbol, the rules' after the ids'."""
    sizes = np.ones(first_rule + len(rules), np.int64)
    for first, after in stages(rules, first_rule):
        sizes[first_rule + first:first_rule + after] = sizes[rules[first:after]].sum(axis=1)
    return sizes


def write(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text",
          end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the ids of all documents, ``end_id`` after each, in ascending order of an integer id.

    Returns the manifest, one row per shard: ``file`` (number in the order of documents), ``path``,
    ``offset``, ``size``, ``before`` (tokens before it in its file), ``n_docs``, ``n_tokens``.
    A null text counts as empty. Null ids come first; rows that share an id keep the order of their
    texts' hashes. An empty table gives no shard.
    """
    folder = staging_path(docs.sparkSession, "token-files")
    rows = docs.select(docs[id_column].cast("bigint").alias("id"),
                       F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    # The number tells equal rows apart, so that those of one hot row go to several tasks.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def work(batches) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        first_rule = coder.tokenizer.get_vocab_size()
        made: list[tuple] = []
        path = stream = None
        at = before = 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            nonlocal path, stream, at, before, held
            if not held:
                return
            if stream is None:
                path = files.new_file(folder, ".ids")
                stream = files.output(path)
            ids, counts, doc_ids, null = map(np.concatenate, zip(*held, strict=True))
            data = Shard.pack(ids, counts, doc_ids, null, first_rule)
            stream.write(data)
            made.append((files.partition(), path, at, len(data), before, len(counts), len(ids)))
            at, before, held = at + len(data), before + len(ids), []

        waiting = 0
        for part in slices(batches, "text"):
            ids, starts, tokens = ended(coder.encode(part["text"]), end_id)
            null = part["id"].is_null().to_numpy(zero_copy_only=False)
            doc_ids = part["id"].fill_null(0).to_numpy(zero_copy_only=False)
            a = 0
            while a < len(tokens):  # whole documents, until a shard is full
                grown = waiting + np.cumsum(tokens[a:])
                b = a + min(len(grown), int(np.searchsorted(grown, shard_tokens)) + 1)
                held.append((ids[starts[a]:starts[b - 1] + tokens[b - 1]], tokens[a:b], doc_ids[a:b], null[a:b]))
                waiting = int(grown[b - a - 1])
                if waiting >= shard_tokens:
                    flush()
                    waiting = 0
                a = b
        flush()
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_arrays(
            [as_array([m[i] for m in made], k) for i, k in enumerate(
                [pa.int32(), pa.string(), *[pa.int64()] * 5])], names=MANIFEST.replace(",", "").split()[::2])

    return staged(placed.mapInArrow(work, MANIFEST), "token-manifest")


MANIFEST = "file int, path string, offset bigint, size bigint, before bigint, n_docs bigint, n_tokens bigint"


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """All documents of a manifest: ``doc_id``, ``start`` (tokens of all documents before it),
    ``n_tokens``, ``ids_crc32``, and ``ids`` unless left out.
    """
    totals = manifest.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    # One row per file: as many as the writing job had tasks.
    earlier = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(F.col("file").alias("_file"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    shards = manifest.join(bases, F.col("file") == F.col("_file")) \
        .select("path", "offset", "size", (F.col("_base") + F.col("before")).alias("start"))
    spread = shards.repartition(max(1, min(manifest.count(), 10_000)), "path", "offset")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def work(batches) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                with files.source(row["path"]) as stream:
                    stream.seek(row["offset"])
                    shard = Shard(stream.read(row["size"]))
                ids = shard.all_ids()
                counts = shard.doc_tokens.astype(np.int64)
                marks = offsets_of(counts)
                made = [pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_null), pa.array(marks[:-1] + row["start"]),
                        pa.array(counts),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(marks[:-1], marks[1:], strict=True)], pa.int64())]
                if with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    made, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(made)])

    return spread.mapInArrow(work, schema)
