import random
import zlib
from collections import Counter

import numpy as np

from hirelake.llm import packing
from hirelake.llm.tokens import encoder, vocabulary_path

WORDS = vocabulary_path("word_bpe_49k.json")


def test_patterns_hold_every_piece_once():
    drawn = random.Random(3)
    for _ in range(200):
        histogram = dict(Counter(drawn.choice([drawn.randint(1, 100), drawn.randint(1, 20)])
                                 for _ in range(drawn.randint(0, 300))))
        packs = packing.patterns(histogram, 100)
        held = Counter()
        for count, lengths in packs:
            assert count > 0 and sum(lengths) <= 100
            for n in lengths:
                held[n] += count
        assert held == histogram
        total = sum(n * c for n, c in histogram.items())
        assert sum(c for c, _ in packs) <= 1.5 * total / 100 + 1


def test_equal_short_pieces_fill_sequences():
    assert sum(c for c, _ in packing.patterns({10: 1000})) == 5
    assert len(packing.patterns({n: 10**12 for n in range(1, 2049)})) < 8192  # grows with lengths, not with pieces


def test_places_are_gapless():
    histogram = {5: 37, 3: 50, 2: 11, 8: 4}
    slots = packing.Slots(packing.patterns(histogram, 10))
    rows = [(int(s), int(o), n) for n, count in histogram.items()
            for s, o in zip(*slots.place(np.full(count, n), np.arange(count)), strict=True)]
    assert_gapless(rows, 10)
    assert {s for s, _, _ in rows} == set(range(slots.sequences))


def assert_gapless(rows, capacity):
    ends = Counter()
    for sequence, offset, length in sorted(rows):
        assert offset == ends[sequence]
        ends[sequence] += length
        assert ends[sequence] <= capacity


def test_rows(odd_docs, no_docs):
    got = packing.packed(packing.cut(odd_docs, WORDS, capacity=64), capacity=64).collect()
    assert_gapless([(r["sequence_id"], r["offset"], r["length"]) for r in got], 64)
    coder = encoder(WORDS)
    wanted = Counter()
    for row in odd_docs.collect():
        ids = [*coder.whole(row["text"] or ""), packing.END_ID]
        for a in range(0, len(ids), 64):
            wanted[(row["doc_id"], a, tuple(ids[a:a + 64]), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], tuple(r["ids"]), r["doc_tokens"]) for r in got) == wanted
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert packing.packed(packing.cut(no_docs, WORDS)).count() == 0


def test_ranks_of_a_hot_length(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id % 11) AS length", "0 AS start", "0 AS ids_crc32")
    got = packing.ranked(rows, ["id", "start", "ids_crc32"]).collect()
    for length, n in Counter(r["length"] for r in got).items():
        assert sorted(r["rank"] for r in got if r["length"] == length) == list(range(n))
