import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hirelake.llm import minhash, shingles
from hirelake.llm.components import components


def words_of(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w.decode() for w in lowered.encode().split()]


def set_of(text, width):
    words = words_of(text)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def by_hand(rows, width):
    """doc_id to (sizes, component), rows with a null id left out."""
    sets = [(d, set_of(t, width)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            shared = len(s & t)
            if a == b or (s and t and 100 * shared >= 80 * (len(s) + len(t) - shared)):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets)


def varied(seed, groups, size, words=80, changed=8):
    """Texts in groups: copies of a base with a few words changed, the changes running on from copy to copy."""
    drawn = random.Random(seed)
    made = []
    for _ in range(groups):
        base = [f"w{drawn.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(drawn.randrange(changed + 1)):
                own[drawn.randrange(words)] = f"v{drawn.randrange(10**6)}"
            made.append(" ".join(own))
            if drawn.random() < 0.4:
                base = own
    return list(enumerate(made))


def test_shingles_are_the_sets():
    drawn = random.Random(7)
    texts = ["".join(drawn.choice(["a ", "b ", "A\n", "\x0bc", " ", "é ", " "]) for _ in range(drawn.randrange(30)))
             for _ in range(200)]
    for width in (1, 2, 5):
        made = shingles.shingle_sets(pa.array([*texts, None]), width)
        names = {}
        for text, own in zip([*texts, None], made, strict=True):
            assert len(own) == len(set_of(text, width))
            assert names.setdefault(set_of(text, width), tuple(own)) == tuple(own)
        assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(spark, width):
    rows = varied(8, 25, 12)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), width)
    wanted = by_hand(rows, width)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == wanted
    assert 25 < len({c for _, _, c in wanted}) < 300
    assert got.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0


def test_one_large_group_of_near_copies(spark):
    rows = varied(9, 1, 400, words=60, changed=5) + [(1000 + i, "the same copy of one text") for i in range(300)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), 2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == by_hand(rows, 2)


def test_links_between_groups(spark):
    """Classes under one key of different groups and components are compared, those of one group are not."""
    members = spark.createDataFrame(
        [(1, 10, 0, 10, 9, True, True), (1, 11, 0, 10, 9, False, False), (1, 12, 0, 10, 9, True, True),
         (1, 13, 0, 10, 9, False, False), (2, 13, 0, 14, 5, True, True), (2, 14, 0, 14, 5, True, True), (2, 11, 0, 14, 5, True, True)],
        "key bigint, rep bigint, sketch bigint, hub bigint, weight bigint, near boolean, fits boolean")
    found = spark.createDataFrame([(12, 10), (10, 10)], "id bigint, component bigint")
    # groups: 10 and 12 with hub 10; 11, 13 and 14 with hub 14
    assert {tuple(r) for r in minhash.across(members, found).collect()} == {(10, 11), (10, 13), (11, 12), (12, 13)}


def test_components(spark):
    drawn = random.Random(10)
    edges = [(drawn.randrange(300), drawn.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 500)] \
        + [(600, 600 + i) for i in range(1, 80)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}
    for a, b in edges:
        if a != b:
            for x in (a, b):
                parent.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b:
                low = min(parent[a], parent[b])
                changed |= parent[a] != low or parent[b] != low
                parent[a] = parent[b] = low
    assert got == parent
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sketches_let_similar_pairs_pass(spark):
    drawn = np.random.default_rng(11)
    pairs = []
    for _ in range(300):
        base = drawn.integers(0, 2**63, 180).astype(np.uint64)
        other = np.concatenate([base[:160], drawn.integers(0, 2**63, 20).astype(np.uint64)])
        sets = [base, other]
        made = minhash.sketches(minhash.minhashes(sets), np.array([180, 180]))
        pairs.append((int(made[0]), int(made[1])))
    frame = spark.createDataFrame(pairs, "x bigint, y bigint")
    assert frame.where(minhash.may_match(F.col("x"), F.col("y"))).count() == 300


def test_rows(spark, odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs, 2).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == by_hand(rows, 2)
    nameless = [(r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None]
    assert sorted(nameless) == [(0, None, True), (4, None, True)]
    assert minhash.near_duplicates(no_docs, 2).count() == 0
