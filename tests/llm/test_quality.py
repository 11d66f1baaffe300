import random
import re
from collections import Counter
from math import comb

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hirelake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def by_hand(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures():
    drawn = random.Random(17)
    texts = [""]
    for _ in range(3000):
        pieces = drawn.choice([["a "], ["a ", "b "], ["a ", "b\n", "c ", "\n", "é\x0b", " ", "#* ", " \n"],
                               ["x y z a b c d e ", " f ", "\n"]])
        texts.append("".join(drawn.choice(pieces) for _ in range(drawn.randint(0, 60))))
    made = quality.measures(pa.array(texts))
    assert list(zip(*[made[n].tolist() for n in BASE], strict=True)) == [by_hand(t) for t in texts]


def test_binomial_bounds():
    for k, n, p in ((0, 10, 0.1), (3, 10, 0.4), (5, 40, 0.05), (10, 10, 0.3)):
        exact = sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact)
    bound = quality.upper_bound(2, 100, 0.05)
    assert quality.binomial_tail(2, 100, bound) == pytest.approx(0.05)
    assert quality.upper_bound(0, 0, 0.05) == 1.0


def test_sequence_ends_at_the_first_failure():
    rules = {"r": (3.0, 2.0, 1.0)}

    def chosen(rejected, good=10_000):
        return [c.cutoff for c in quality.select_cutoffs({"s": (good, {"r": rejected})}, 0.01, 0.05, rules)]

    assert chosen([0, 0, 0]) == [1.0]
    assert chosen([0, 50, 300]) == [2.0]
    assert chosen([0, 300, 0]) == [3.0]
    assert chosen([300, 0, 0]) == []
    assert chosen([0, 0, 0], good=100) == []  # too few labels to be sure


def test_false_rejection_stays_within_the_limit():
    """Over many holdouts, the chosen cutoff's true rate passes the limit no more often than delta allows."""
    drawn = random.Random(18)
    limit, delta, n = 0.05, 0.1, 400
    cutoffs = tuple(1 - r for r in (0.01, 0.03, 0.045, 0.055, 0.07, 0.1))
    passed = 0
    for _ in range(400):
        values = [drawn.random() for _ in range(n)]
        counts = [sum(v > c for v in values) for c in cutoffs]
        chosen = quality.select_cutoffs({"s": (n, {"r": counts})}, limit, delta, {"r": cutoffs})
        passed += bool(chosen) and 1 - chosen[0].cutoff > limit
    assert passed <= 400 * delta


def corpus(spark):
    drawn = random.Random(19)

    def words(n):
        return " ".join(f"w{drawn.randrange(10**6)}" for _ in range(n))

    junk = " ".join(f"$$$$$$$$${i}" for i in range(30))
    rows = [(i, words(60), "en") for i in range(2500)] + [(5000 + i, f"{words(25)} {junk}", "en") for i in range(100)]
    rows += [(6000 + i, f"{words(25)} {junk}", "xx") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = docs.selectExpr("doc_id", "int(doc_id < 5000) AS quality", "0 AS toxic")
    return docs, labels


def test_junk_goes_and_clean_documents_stay(spark):
    docs, labels = corpus(spark)
    got = quality.judged(docs, labels)
    assert got.where("doc_id < 5000 AND NOT kept").count() == 0
    assert got.where("doc_id BETWEEN 5000 AND 5999 AND kept").count() == 0
    assert got.where("doc_id >= 6000 AND kept").count() == 5  # a stratum without labels keeps its rows
    rest = quality.kept(docs, labels)
    assert rest.columns == docs.columns
    assert {r["doc_id"] for r in rest.collect()} == {r["doc_id"] for r in got.where("kept").collect()}
    assert quality.judged(docs, labels.limit(0)).where("NOT kept").count() == 0


def test_repeated_words_reject_below_the_base_limit(spark):
    drawn = random.Random(20)

    def text(n, again):
        words = [f"w{drawn.randrange(10**6)}" for _ in range(n)]
        return " ".join(words + words[:8] * again)

    rows = [(i, text(60, 0), "en") for i in range(2500)] + [(5000 + i, text(60, 1), "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = quality.judged(docs, docs.selectExpr("doc_id", "int(doc_id < 5000) AS quality", "0 AS toxic"))
    assert got.where("doc_id >= 5000 AND NOT base_failed AND NOT kept").count() == 50
    assert got.where("doc_id < 5000 AND kept").count() == 2500


def test_steps_are_nested():
    steps = quality.ladder({"a": (3.0, 2.0), "b": (0.5,), "c": (9.0, 8.0)}, ("c",))
    assert steps == ({"a": 3.0}, {"a": 3.0, "b": 0.5}, {"a": 2.0, "b": 0.5}, {"a": 2.0, "b": 0.5, "c": 9.0},
                     {"a": 2.0, "b": 0.5, "c": 8.0})
    assert quality.LADDER[-1] == {rule: cutoffs[-1] for rule, cutoffs in quality.CANDIDATES.items()}
    for mild, strict in zip(quality.LADDER, quality.LADDER[1:]):
        assert sum(mild.get(r) != c for r, c in strict.items()) == 1
        assert all(strict[r] <= c for r, c in mild.items())


def test_small_strata_are_certified():
    """Without a false rejection, 194 good documents do for a stratum of five; the false ones of all rules count together."""
    n = len(quality.LADDER)
    counts = {s: (0, {quality.UNION: [0] * n}) for s in (*quality.STRATA, quality.OTHER)}
    for good, passed in ((193, []), (194, [quality.LADDER[-1]])):
        made = quality.select_cutoffs(counts | {"de": (good, {quality.UNION: [0] * n})})
        assert [c.cutoff for c in made] == passed
    made = quality.select_cutoffs(counts | {"de": (1000, {quality.UNION: [0] * 5 + [9] * 3 + [12] * (n - 8)})})
    assert [c.cutoff for c in made] == [quality.LADDER[7]] and made[0].bound <= quality.ALPHA


def test_union_of_the_rules_stays_within_the_limit():
    """Over many holdouts, what any rule of the chosen step rejects passes the limit no more often than delta allows."""
    drawn = random.Random(21)
    steps = quality.ladder({r: (0.995, 0.99, 0.98, 0.97) for r in "abc"})
    limit, delta, n, passed = 0.05, 0.1, 400, 0
    for _ in range(300):
        docs = [[drawn.random() for _ in "abc"] for _ in range(n)]
        counts = [sum(any(d["abc".index(r)] > c for r, c in step.items()) for d in docs) for step in steps]
        for c in quality.select_cutoffs({"s": (n, {"u": counts})}, limit, delta, {"u": steps}):
            kept = 1.0
            for cutoff in c.cutoff.values():
                kept *= cutoff
            passed += 1 - kept > limit
    assert passed <= 300 * delta


def test_junk_goes_in_a_small_stratum(spark):
    """Counts of the holdout against a plain loop, and junk out of a stratum of 250 good documents."""
    drawn = random.Random(22)

    def text(n, junk=0, shouts=0):
        words = [f"w{drawn.randrange(10**6)}" + "!" * (i < shouts) for i in range(n)]
        return " ".join(words + [f"{'$' * 9}{i}" for i in range(junk)])

    rows = [(i, text(60, shouts=30 * (i == 7)), "de") for i in range(250)]
    rows += [(5000 + i, text(30, junk=10), "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = docs.selectExpr("doc_id", "int(doc_id < 5000) AS quality", "0 AS toxic")
    counts = quality.holdout_counts(quality.with_measures(docs.withColumn("mark", F.xxhash64("text"))), labels, "doc_id", "lang", quality.STRATA, "mark")
    ratio = 30 / 60  # exclamations per word of document 7
    assert counts["de"] == (250, {quality.UNION: [
        int(ratio > step.get("exclamations_per_word", 9)) for step in quality.LADDER]})
    assert counts["en"] == (0, {quality.UNION: [0] * len(quality.LADDER)})
    got = quality.judged(docs, labels)
    assert got.where("doc_id >= 5000 AND NOT base_failed AND NOT kept").count() == 40
    assert got.where("doc_id < 5000 AND kept").count() == 250


def test_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    got = quality.judged(odd_docs, labels)
    wanted = Counter((r["doc_id"], *by_hand(r["text"] or "")) for r in odd_docs.collect())
    assert Counter(tuple(r) for r in got.select("doc_id", *BASE).collect()) == wanted
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    assert got.where((F.col("base_failed") != failed) | (F.col("kept") & failed)).count() == 0
    assert quality.judged(no_docs, labels).count() == 0 and quality.kept(no_docs, labels).count() == 0
    assert quality.kept(odd_docs, labels).columns == odd_docs.columns


def test_copies_are_one_trial(spark):
    """Rows under one id, and copies of one text, certify nothing that one document would not."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "de")] * 300 + [(10 + i, words + " copied", "fr") for i in range(300)] + [(1000 + i, f"{words} x{i}", "en") for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(d,) for d in {r[0] for r in rows}], "doc_id bigint").selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    marked = quality.with_measures(docs.withColumn("mark", F.xxhash64("text")))
    counts = quality.holdout_counts(marked, labels, "doc_id", "lang", quality.STRATA, "mark")
    assert {s: n for s, (n, _) in counts.items()} == {"de": 1, "fr": 1, "en": 250, "es": 0, "other": 0}
    assert {c.stratum for c in quality.select_cutoffs(counts)} == {"en"}


def test_columns_may_have_any_name(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(30 + i)), "en", 1, 2, "x") for i in range(5)] + [(9, "short", "en", 1, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _measures int, _MEASURES_ int, _mark string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    left = quality.kept(docs, labels)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == list(range(5))
    assert quality.judged(docs, labels).where("kept").count() == 5
