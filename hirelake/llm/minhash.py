"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of ``HALVES`` half keys are made, each of ``ROWS`` minhashes; a table's key combines one
half of either collection, so 2 * 10 * 2 = 40 minhashes fill 100 tables of four rows, where separate bands
would take 400. A pair of similarity s shares no table with a chance of at most 2 * (1 - s**2)**10: 7e-5
at 0.8, 4e-8 at 0.9.

Documents with equal shingle sets form one class; from there on only classes count. In each table a class
is compared with the key's hub, the class that meets most others. Classes under one key that are not
connected by then are compared with one another, except within the largest component, so no candidate
pair is left out: those near the same hub in blocks inside tasks, from which only links come out,
the rest as pairs. A sketch of 18 minhashes of three bits rules out candidates of clearly lower
similarity (chance to lose a pair at 0.8: 2e-5).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.batches import map_slices, offsets_of
from hirelake.llm.components import components
from hirelake.llm.shingles import mixed, shingle_sets
from hirelake.operators.keys import lookup
from hirelake.session import staged

HALVES = 10
ROWS = 2
MINHASHES = 2 * HALVES * ROWS
SKETCH = 18
SKETCH_BITS = 3
SKETCH_EQUAL = 8
# So many equal minhashes put a class into the group of a hub.
SKETCH_NEAR = 5
# Size classes grow by a sixteenth in the logarithm; sets of similarity 0.8 differ by 4 at most.
SIZE_STEP = 16
SIZE_BITS = 8
SIMILAR = 80  # per cent
# Sets that meet in one task: all of a group on one side, those outside its largest component on the other.
GROUP_ROWS = 2048
GROUP_FEW = 512
# Ids below which a list of documents is sent to all executors (8 bytes each).
BROADCAST_IDS = 1_000_000


def multipliers() -> np.ndarray:
    return mixed(np.arange(1, MINHASHES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minhashes for every set that is not empty."""
    sizes = np.array([len(s) for s in sets if len(s)], np.int64)
    if not len(sizes):
        return np.zeros((0, MINHASHES), np.uint64)
    flat = np.concatenate([s for s in sets if len(s)])
    starts = offsets_of(sizes)[:-1]
    made = np.empty((len(sizes), MINHASHES), np.uint64)
    for k, m in enumerate(multipliers()):
        made[:, k] = np.minimum.reduceat(flat * m, starts)
    return made


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Three bits each of the first minhashes, then the size class, in 62 bits."""
    spread = mixed(hashes[:, :SKETCH])
    made = np.zeros(len(hashes), np.uint64)
    for k in range(SKETCH):
        made = made << np.uint64(SKETCH_BITS) | spread[:, k] & np.uint64((1 << SKETCH_BITS) - 1)
    size = np.minimum(np.floor(np.log(np.maximum(sizes, 1)) * SIZE_STEP), (1 << SIZE_BITS) - 1)
    return (made << np.uint64(SIZE_BITS) | size.astype(np.uint64)).astype(np.int64)


def unequal(x: Column, y: Column) -> Column:
    """How many of two sketches' minhashes differ."""
    differ = F.shiftright(x.bitwiseXOR(y), SIZE_BITS)
    ones = sum(1 << (SKETCH_BITS * k) for k in range(SKETCH))
    some = differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseOR(F.shiftright(differ, 2)).bitwiseAND(F.lit(ones))
    return F.bit_count(some)


def may_match(x: Column, y: Column) -> Column:
    """False only for sketches of sets that are (almost surely) less similar than ``SIMILAR``."""
    low = F.lit((1 << SIZE_BITS) - 1)
    sizes = F.abs(x.bitwiseAND(low) - y.bitwiseAND(low))
    return (unequal(x, y) <= SKETCH - SKETCH_EQUAL) & (sizes <= 4)


def summaries(docs: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, and unless empty ``set_id``, half keys ``x``, ``y``, ``sketch``."""
    schema = "doc_id bigint, n_shingles bigint, set_id binary, x array<bigint>, y array<bigint>, sketch bigint"

    def work(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(part["text"], width)
        sizes = np.array([len(s) for s in sets], np.int64)
        empty = sizes == 0
        hashes = minhashes(sets)
        at = np.cumsum(~empty) - 1
        sketch = sketches(hashes, sizes[~empty])
        halves = mixed(hashes[:, 0::2] * np.uint64(0x9E3779B97F4A7C15) + mixed(hashes[:, 1::2])).astype(np.int64)

        def listed(values: np.ndarray) -> pa.Array:
            marks = pa.array(offsets_of(np.where(empty, 0, HALVES)), pa.int32())
            return pa.ListArray.from_arrays(marks, pa.array(values.reshape(-1)))

        return {"doc_id": part["doc_id"], "n_shingles": sizes,
                "set_id": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                "x": listed(halves[:, :HALVES]), "y": listed(halves[:, HALVES:]),
                "sketch": pa.array(sketch[at] if len(sketch) else np.zeros(len(sets), np.int64), mask=empty)}

    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return map_slices(rows, "text", schema, work)


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, rep, sketch): a row for each class and table."""
    key = F.flatten(F.transform("x", lambda a, i: F.transform("y", lambda b, j: F.xxhash64(a, b, i * HALVES + j))))
    return classes.select(F.explode(key).alias("key"), "rep", "sketch")


def keyed(classes: DataFrame) -> DataFrame:
    """(key, rep, sketch, hub, weight, near, fits): the classes under every key that several have.

    The hub is the class that meets most others over all its keys (``weight``): in a group of copies the
    text they were made from, or one close to it. ``fits``: the sketches of class and hub may match;
    ``near``: they are alike enough for both to belong to one group.
    """
    keys = table_keys(classes)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = staged(lookup(keys, shared, ["key"], ["key"], how="inner"), "shared-keys")
    weights = rows.groupBy("rep").agg(F.sum("n").alias("weight"))
    weighed = lookup(rows, weights, ["rep"], ["rep"]).withColumn("best", F.struct("weight", (-F.col("rep")).alias("r"), "sketch"))
    hubs = weighed.groupBy("key").agg(F.max("best").alias("h")) \
        .select("key", (-F.col("h.r")).alias("hub"), F.col("h.weight").alias("weight"), F.col("h.sketch").alias("other"))
    return lookup(weighed.drop("best", "weight", "n"), hubs, ["key"], ["key"], how="inner").select(
        "key", "rep", "sketch", "hub", "weight", (unequal(F.col("sketch"), F.col("other")) <= SKETCH - SKETCH_NEAR).alias("near"),
        may_match(F.col("sketch"), F.col("other")).alias("fits"))


def sets_of(docs: DataFrame, ids: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """Full shingle sets of the documents named."""
    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].cast("string").alias("text"))

    def work(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(part["text"], width)
        flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
        marks = pa.array(offsets_of(np.array([len(s) for s in sets], np.int64)), pa.int32())
        return {"doc_id": part["doc_id"], "shingles": pa.ListArray.from_arrays(marks, pa.array(flat))}

    return map_slices(picked(rows, ids), "text", "doc_id bigint, shingles array<bigint>", work)


def picked(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Documents with (or, ``left_anti``, without) an id of ``ids`` (``id``), which is sent out if short."""
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), docs["doc_id"] == ids["id"], how)
    return lookup(docs, ids, ["doc_id"], ["id"], how=how)


def pair_sets(pairs: DataFrame, docs: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """The full sets of all ids of the pairs (``a``, ``b``)."""
    ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
    return staged(sets_of(docs, staged(ids, "pair-ids"), width, id_column, text_column), "pair-sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = lookup(pairs, sets.withColumnRenamed("shingles", "s"), ["a"], ["doc_id"], how="inner")
    two = lookup(one, sets.withColumnRenamed("shingles", "t"), ["b"], ["doc_id"], how="inner")
    shared = F.size(F.array_intersect("s", "t"))
    return two.where(100 * shared >= SIMILAR * (F.size("s") + F.size("t") - shared)).select("a", "b").distinct()


def within_groups(stars: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between classes compared with the same hub (``a``) that are not connected so far.

    Classes outside the hub's largest component are held against all of the hub's classes, in blocks of
    bounded size: the full sets meet inside a task, and only links come out, one for each class and
    component it links with.
    """
    rows = lookup(stars, found, ["b"], ["id"]).select("a", "b", F.coalesce("component", "b").alias("component"))
    counts = rows.groupBy("a", "component").agg(F.count("*").alias("n"))
    groups = counts.groupBy("a").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"),
                                     F.count("*").alias("k")) \
        .where("k > 1").select("a", F.col("m.component").alias("main"), (F.col("n") - F.col("m.n")).alias("few"), "n")
    blocks = F.ceil(F.col("n") / GROUP_ROWS)
    parts = F.ceil(F.col("few") / GROUP_FEW)
    rows = staged(lookup(rows, groups, ["a"], ["a"], how="inner").select(
        "a", "b", "component", "main", blocks.alias("blocks"), parts.alias("parts")), "groups")
    full = lookup(rows, sets, ["b"], ["doc_id"], how="inner")
    mark = F.xxhash64("b")
    each = full.select("a", F.pmod(mark, F.col("blocks")).alias("block"),
                       F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
                       "b", "component", "shingles")
    few = full.where("component <> main").select(
        "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"),
        F.pmod(mark, F.col("parts")).alias("part"), "b", "component", "shingles")
    few = few.select(*[F.col(c).alias(f"few_{c}") for c in few.columns])
    keys = ["a", "block", "part"]
    return each.groupBy(*keys).cogroup(few.groupBy(*[f"few_{k}" for k in keys])) \
        .applyInArrow(block_links, "a bigint, b bigint").distinct()


def block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of every set on the right, one link to each component on the left that it is similar to."""
    links: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        flat = left["shingles"].combine_chunks().flatten().to_numpy()
        sizes = left["shingles"].combine_chunks().value_lengths().to_numpy()
        starts = offsets_of(sizes)[:-1]
        known, places = np.unique(flat, return_inverse=True)
        ids, components_ = left["b"].to_numpy(), left["component"].to_numpy()
        own = right["few_shingles"].combine_chunks()
        for i, (b, component) in enumerate(zip(right["few_b"].to_pylist(), right["few_component"].to_pylist(), strict=True)):
            one = own[i].values.to_numpy()
            at = np.minimum(np.searchsorted(known, one), len(known) - 1)
            hit = np.zeros(len(known), np.int32)
            hit[at[known[at] == one]] = 1
            shared = np.add.reduceat(hit[places], starts).astype(np.int64)
            linked = np.flatnonzero((100 * shared >= SIMILAR * (sizes + len(one) - shared)) & (components_ != component))
            _, first = np.unique(components_[linked], return_index=True)
            links += [(b, int(ids[k])) for k in linked[first]]
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def near_duplicates(docs: DataFrame, width: int = 5, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over links of
    similarity 0.8 or more, its own included), ``kept`` (``doc_id`` is the component's).

    Words are split at ASCII white space, A-Z counts as a-z. A text of fewer words than ``width`` is
    one shingle; null, empty and blank texts have none and link with nothing, not even one another.
    Rows that share an id are one document, linked where any of its texts is. A row with a null id
    links with nothing: its component is null, and it is kept. Columns other than the two named are not read.
    """
    rows = staged(summaries(docs, width, id_column, text_column), "summaries")
    linked = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(linked.groupBy("set_id").agg(F.min(F.struct("doc_id", "sketch", "x", "y")).alias("c"))
                     .select("set_id", F.col("c.doc_id").alias("rep"), "c.sketch", "c.x", "c.y"), "classes")
    members = staged(keyed(classes), "members")

    pair = [F.col("hub").alias("a"), F.col("rep").alias("b")]
    stars = staged(members.where("near AND rep <> hub").groupBy(*pair).agg(F.max("fits").alias("fits")), "stars")
    sets = pair_sets(stars, docs, width, id_column, text_column)
    edges = staged(confirmed(stars.where("fits").drop("fits"), sets), "links")
    found = components(edges)
    more = staged(within_groups(stars.drop("fits"), found, sets), "links")
    edges, found = joined(edges, found, more)
    rest = staged(across(members, found), "rest")
    if rest.limit(1).count():
        more = staged(confirmed(rest, pair_sets(rest, docs, width, id_column, text_column)), "links")
        edges, found = joined(edges, found, more)

    placed = staged(lookup(rows.drop("x", "y", "sketch"), classes.select("set_id", "rep"), ["set_id"], ["set_id"],
                           row_id="doc_id"), "placed")
    several = placed.where("doc_id IS NOT NULL AND rep IS NOT NULL").groupBy("doc_id") \
        .agg(F.min("rep").alias("_low"), F.max("rep").alias("_high")).where("_low <> _high")
    same_id = lookup(placed, several, ["doc_id"], ["doc_id"], how="inner") \
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("b IS NOT NULL")
    _, found = joined(edges, found, staged(same_id, "same-ids"))
    named = lookup(placed, found, ["rep"], ["id"], row_id="doc_id")
    component = F.coalesce("component", "rep", "doc_id")
    return named.select("doc_id", "n_shingles",
                        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def joined(edges: DataFrame, found: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All edges and their components, found anew only if there are more edges."""
    if not more.limit(1).count():
        return edges, found
    edges = edges.unionByName(more)
    return edges, components(edges)


def across(members: DataFrame, found: DataFrame) -> DataFrame:
    """Candidate pairs under one key that are in different components so far and in different groups.

    A class belongs to the group of the weightiest hub it is near to, whichever key they met under; pairs within
    a group have been compared. One of either pair is outside the key's largest component.
    """
    best = members.where("near").groupBy("rep").agg(F.max(F.struct("weight", (-F.col("hub")).alias("h"))).alias("m"))
    home = best.select("rep", (-F.col("m.h")).alias("home"))
    rows = lookup(members.select("key", "rep", "sketch"), found, ["rep"], ["id"]) \
        .select("key", "rep", "sketch", F.coalesce("component", "rep").alias("component"))
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    mains = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("k")) \
        .where("k > 1").select("key", F.col("m.component").alias("main"))
    open_rows = lookup(rows, mains, ["key"], ["key"], how="inner")
    open_rows = staged(lookup(open_rows, home, ["rep"], ["rep"])
                       .select("key", "rep", "sketch", "component", "main", F.coalesce("home", "rep").alias("home")), "open")
    few = open_rows.where("component <> main").select(
        F.col("key").alias("k2"), F.col("rep").alias("r2"), F.col("sketch").alias("s2"), F.col("component").alias("c2"),
        F.col("home").alias("h2"))
    on = (F.col("key") == F.col("k2")) & (F.col("component") != F.col("c2")) & (F.col("home") != F.col("h2")) \
        & may_match(F.col("sketch"), F.col("s2"))
    return open_rows.join(few, on).select(F.least("rep", "r2").alias("a"), F.greatest("rep", "r2").alias("b")).distinct()


# The same result by comparing all pairs that share a shingle.
SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM sets p JOIN sets q ON p.s = q.s AND p.doc_id < q.doc_id
  GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents
  UNION SELECT edges.b, reach.c FROM reach JOIN edges ON edges.a = reach.a)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id GROUP BY d.doc_id, z.n
"""
