import random
import zlib

import numpy as np

from hirelake.llm import files, repair
from hirelake.llm.tokens import encoder, vocabulary_path

WORDS = vocabulary_path("word_bpe_49k.json")
FIRST = 49408


def shard(docs):
    counts = np.array([len(d) for d in docs], np.int64)
    ids = np.array([i for d in docs for i in d], np.uint32)
    return repair.Shard(repair.Shard.pack(ids, counts, np.arange(len(docs)), np.zeros(len(docs), bool), FIRST))


def random_docs(seed, n=300):
    drawn = random.Random(seed)
    phrases = [[drawn.randrange(50) for _ in range(drawn.randint(2, 9))] for _ in range(20)]
    return [[i for _ in range(drawn.randint(0, 30)) for i in drawn.choice(phrases)] + [1] for _ in range(n)]


def test_round_trip_and_random_access():
    docs = random_docs(4)
    made = shard(docs)
    assert len(made.symbols) < sum(map(len, docs)) / 2 and len(made.rules)
    assert made.all_ids().tolist() == [i for d in docs for i in d]
    drawn = random.Random(5)
    for i, d in enumerate(docs):
        assert made.document(i).tolist() == d
        a, b = sorted((drawn.randint(0, len(d)), drawn.randint(0, len(d))))
        assert made.document(i, a, b).tolist() == d[a:b]
        assert made.document(i, len(d), len(d) + 5).tolist() == []


def test_runs_of_one_id_and_empty_documents():
    for docs in ([[7] * 1001], [[7] * n for n in range(60)], [[], [1], [], [2, 3]], [[]], []):
        made = shard(docs)
        assert made.all_ids().tolist() == [i for d in docs for i in d]
        assert [made.document(i).tolist() for i in range(len(docs))] == docs


def test_rules_stand_on_earlier_symbols_and_sizes_hold():
    made = shard(random_docs(6))
    for i, (a, b) in enumerate(made.rules.tolist()):
        assert a < FIRST + i and b < FIRST + i
        assert made.sizes[FIRST + i] == made.sizes[a] + made.sizes[b]


def pair_counts(made):
    """Occurrences of every pair inside the documents, those of a run of one symbol not over one another."""
    seen = {}
    at = 0
    for n in made.doc_symbols.tolist():
        own, at = made.symbols[at:at + n].tolist(), at + n
        taken = -1
        for i, pair in enumerate(zip(own, own[1:])):
            if pair[0] == pair[1] and taken == i - 1:
                continue
            taken = i if pair[0] == pair[1] else -1
            seen[pair] = seen.get(pair, 0) + 1
    return seen


def test_what_is_left_is_rare():
    for seed in range(6):
        docs = random_docs(seed, 120)
        made = shard(docs)
        assert made.all_ids().tolist() == [i for d in docs for i in d]
        left = [n for n in pair_counts(made).values() if n >= repair.FREQUENT]
        # Only pairs that lie over one another may be left, and few of them.
        assert len(left) <= 2
    tail = [9, 8, 7]
    made = shard([[100 + i, *tail, 200 + i] for i in range(repair.FREQUENT)])
    assert len(made.rules) == 2 and len(made.symbols) == 3 * repair.FREQUENT
    assert not len(shard([[100 + i, *tail, 200 + i] for i in range(repair.FREQUENT - 1)]).rules)


def test_symbols_past_sixteen_bits():
    drawn = np.random.default_rng(3)
    pairs = drawn.integers(0, FIRST, (20_000, 2))
    docs = [pairs[i].tolist() for _ in range(4) for i in drawn.permutation(20_000)]
    made = shard([sum(docs[i:i + 50], []) for i in range(0, len(docs), 50)])
    assert FIRST + len(made.rules) > 1 << 16 and made.symbols.max() >= 1 << 16
    assert made.all_ids().tolist() == [i for d in docs for i in d]
    assert made.document(7, 20, 41).tolist() == sum(docs[350:400], [])[20:41]


def test_long_copies():
    drawn = np.random.default_rng(4)
    text = drawn.integers(0, FIRST, 3000).tolist()
    made = shard([text] * 64)
    assert made.doc_symbols.tolist() == [1] * 64 and made.rule_sizes.max() == 3000
    assert made.document(63, 2990).tolist() == text[2990:]


def test_equal_rows_go_to_several_tasks(spark):
    docs = spark.range(20_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "'' AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = repair.write(docs, WORDS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.select("file").distinct().count() > 1
    got = repair.read(manifest, with_ids=False)
    assert got.count() == 20_000 and got.agg({"start": "max"}).first()[0] == 19_999


def test_pairs_across_documents_stay():
    made = shard([[5, 1]] * 100)
    assert made.doc_symbols.tolist() == [1] * 100


def test_files(spark, odd_docs, no_docs):
    manifest = repair.write(odd_docs, WORDS, shard_tokens=3000)
    assert manifest.count() > 1
    got = sorted(repair.read(manifest).collect(), key=lambda r: r["start"])
    coder = encoder(WORDS)
    wanted = sorted(((-1 if r["doc_id"] is None else r["doc_id"], [*coder.whole(r["text"] or ""), 1])
                     for r in odd_docs.collect()), key=lambda x: x[0])
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == [w[0] for w in wanted]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == sorted(wanted)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert repair.read(repair.write(no_docs, WORDS)).count() == 0


def test_one_document_of_a_file(spark):
    docs = spark.createDataFrame([(5, "five words are in here"), (2, "two")], "doc_id int, text string")
    row = repair.write(docs, WORDS).orderBy("file", "offset").first()
    with files.source(row["path"]) as stream:
        stream.seek(row["offset"])
        made = repair.Shard(stream.read(row["size"]))
    assert made.doc_ids[0] == 2
    assert made.document(0).tolist() == [*encoder(WORDS).whole("two"), 1]


def test_pairs_sort_alike_in_one_number_and_by_an_order():
    drawn = np.random.default_rng(9)
    symbols = drawn.integers(0, 40, 5000).astype(np.uint32)
    at = np.flatnonzero(drawn.random(4999) < 0.7)
    wide = symbols.copy()
    wide[-1] = 1 << 31  # behind all pairs: only makes the symbols too wide for one number
    at = at[at < 4998]
    wanted = sorted(zip(symbols[at].tolist(), symbols[at + 1].tolist(), strict=True))
    for given in (symbols, wide):
        pairs, places = repair.by_pair(given, at)
        assert list(zip(symbols[places].tolist(), symbols[places + 1].tolist(), strict=True)) == wanted
        assert sorted(places.tolist()) == at.tolist()
        assert [int(n) for n in np.diff(pairs) > 0] == [int(a != b) for a, b in zip(wanted, wanted[1:])]


def test_pairs_are_counted_again_only_where_something_changed(monkeypatch):
    counted = []
    plain = repair.likely
    monkeypatch.setattr(repair, "likely", lambda symbols, *rest: counted.append(rest[-1]) or plain(symbols, *rest))
    for seed in range(4):
        counted.clear()
        made = shard(random_docs(seed, 120))
        assert max(map(counted.count, counted)) == 1
        assert sum(n >= repair.FREQUENT for n in pair_counts(made).values()) <= 2
