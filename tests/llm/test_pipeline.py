import random
from collections import Counter

import corpus_pipeline
from hirelake.llm import minhash, packing, secrets
from hirelake.llm.queries import CHECKS, QUERIES
from hirelake.llm.tokens import encoder, vocabulary_path

duckdb = __import__("pytest").importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def test_queries_equal_their_sql(spark):
    for name, sql in CHECKS.items():
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        shown = con.sql(sql)
        got = QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(shown.columns)
        assert Counter(tuple(r) for r in got.select(*shown.columns).collect()) == Counter(shown.fetchall()), name


def test_every_operator_reads_its_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, query in QUERIES.items():
        if "doc_id" in (got := query(spark, SF)).columns:
            assert {r["doc_id"] for r in got.select("doc_id").collect()} == ids, name


def by_hand(docs, labels):
    """The rows of the pipeline but for the sequences, with plain loops."""
    from test_minhash import by_hand as components
    from test_quality import by_hand as measured

    kept = []
    for r in docs:
        n_words, *_, repeated = measured(r["text"] or "")
        if n_words >= 20 and 100 * repeated <= 30 * n_words:
            kept.append((r["doc_id"], r["text"]))
    assert not labels  # without labels only the base rule rejects
    kept = [(d, t) for (d, t), (_, _, c) in zip(sorted(kept), components(sorted(kept), 5), strict=True) if d == c]
    coder = encoder(vocabulary_path("word_bpe_49k.json"))
    made = []
    for d, t in kept:
        ids = [*coder.whole(secrets.masked(t, secrets.scan(t))), packing.END_ID]
        made += [(d, a, tuple(ids[a:a + 2048])) for a in range(0, len(ids), 2048)]
    return sorted(made)


def test_run(spark, tmp_path):
    drawn = random.Random(25)
    base = [f"w{drawn.randrange(999)}" for _ in range(300)]
    rows = [(i, " ".join(drawn.sample(base, 40)) + " token = abcdefghijkl0123", "en", "s", 0) for i in range(40)]
    rows += [(100 + i, rows[3][1] + " more words" * (i % 2), None, None, None) for i in range(5)]
    rows += [(200, None, "en", "s", None), (201, "", "en", "s", 0), (202, "too few words", "en", "s", 0),
             (203, "a b c d e f g h " * 20, "en", "s", 0), (204, " ".join(base * 30), "en", "s", 0),
             (205, " ".join(f"u{i}" for i in range(5000)), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["start"], tuple(r["ids"])) for r in got) == by_hand(docs.collect(), [])
    fill = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= sum(fill.values()) // 2048 + 2


def test_stages_keep_columns_and_odd_rows(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 0, None)], "doc_id bigint, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, str(tmp_path))
            assert made.columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    left = corpus_pipeline.near_duplicates(spark, odd_docs, str(tmp_path))
    # ids 4 and 9 hold one text; all rows of id 3 and all rows without an id stay
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([0, 1, 2, 3, 3, 3, 4, 5, 6, 7, 8, None, None])


def test_long_lists_of_ids_are_joined(spark, odd_docs, monkeypatch):
    ids = spark.createDataFrame([(1,), (3,)], "id bigint")
    for how in ("left_semi", "left_anti"):
        sent = minhash.picked(odd_docs.drop("id"), ids, how).collect()
        monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
        assert Counter(minhash.picked(odd_docs.drop("id"), ids, how).collect()) == Counter(sent)
        monkeypatch.undo()
