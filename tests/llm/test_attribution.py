import random

import numpy as np
import pytest

from hirelake.llm import attribution as at
from hirelake.llm.tokens import encoder, vocabulary_path

BYTES = vocabulary_path("byte_bpe_50k.json")


def by_hand(first, end, starts, ends, rule):
    made = []
    for a, b in zip(first, end, strict=True):
        if rule == "majority":
            shared = [min(b, e) - max(a, s) for s, e in zip(starts, ends, strict=True)]
            best = max(shared, default=0)
            made.append(shared.index(best) if best > 0 else -1)
        else:
            place = a if rule == "start" else b - 1
            inside = [i for i, (s, e) in enumerate(zip(starts, ends, strict=True)) if s <= place < e]
            made.append(inside[0] if inside else -1)
    return made


@pytest.mark.parametrize("rule", at.RULES)
def test_interval_join(rule):
    drawn = random.Random(2)
    for _ in range(300):
        marks = sorted(drawn.sample(range(60), drawn.randrange(0, 9) * 2))
        starts, ends = np.array(marks[::2], int), np.array(marks[1::2], int)
        cuts = [0, *sorted(drawn.sample(range(1, 60), 12)), 60]
        first, end = np.array(cuts[:-1]), np.array(cuts[1:])
        assert at.attribute(first, end, starts, ends, rule).tolist() == by_hand(first, end, starts, ends, rule)


def test_sections_that_touch_and_empty_ones():
    starts, ends = np.array([0, 3, 3, 6]), np.array([3, 3, 6, 9])
    assert at.attribute(np.array([0, 2, 5]), np.array([2, 5, 9]), starts, ends).tolist() == [0, 2, 3]


def test_spans_are_the_librarys():
    coder = encoder(BYTES)
    text = "Ünï 漢字🙂 it's\n\nfine  <|endoftext|> end "
    ids = np.array(coder.whole(text))
    first, end = at.spans(coder, ids, text.encode())
    assert list(zip(first.tolist(), end.tolist(), strict=True)) == \
        coder.tokenizer.encode(text, add_special_tokens=False).offsets


def test_counts_add_up(odd_docs, no_docs):
    got = at.attributed(odd_docs, BYTES, sections_column=None).collect()
    coder = encoder(BYTES)
    for row in odd_docs.where("doc_id <> 3 AND doc_id IS NOT NULL").collect():
        own = [r for r in got if r["doc_id"] == row["doc_id"]]
        total = len(coder.whole(row["text"] or ""))
        assert sum(r["n_tokens"] for r in own) == total
        assert {r["doc_tokens"] for r in own} == {total}
        assert sum(r["section"] is not None for r in own) == len((row["text"] or "").split("\n"))
    assert at.attributed(no_docs, BYTES, sections_column=None).count() == 0


def test_fields(spark):
    docs = spark.createDataFrame([(1, "head", None, "body text here"), (None, None, None, None)],
                                 "doc_id bigint, `a` string, `b c` string, text string")
    got = at.attributed(at.field_sections(docs, ["a", "b c", "text"]), BYTES).where("doc_id = 1").collect()
    assert {r["name"]: r["n_tokens"] for r in got} == {"none": 2, "a": 1, "b c": 0, "text": 3}
    nothing = docs.selectExpr("doc_id", "text", "cast(null as array<struct<name:string,start:int,end:int>>) AS sections")
    assert {(r["doc_id"], r["section"], r["n_tokens"]) for r in at.attributed(nothing, BYTES).collect()} == \
        {(1, None, 3), (None, None, 0)}


def test_crossing_tokens(spark):
    docs = spark.createDataFrame([(1, "ab the cd", [("x", 0, 4), ("y", 4, 9)])],
                                 "doc_id int, text string, sections array<struct<name:string,start:int,end:int>>")
    counts = {rule: {r["name"]: (r["n_tokens"], r["n_crossing"]) for r in at.attributed(docs, BYTES, rule=rule).collect()}
              for rule in at.RULES}
    # tokens: "ab", " the" (characters 2 to 6, half in each), " cd"
    assert counts["start"] == {"x": (2, 1), "y": (1, 0)}
    assert counts["end"] == {"x": (1, 0), "y": (2, 1)}
    assert counts["majority"] == {"x": (2, 1), "y": (1, 0)}
    with pytest.raises(ValueError):
        at.attributed(docs, BYTES, rule="half")


def test_lines_of_a_text():
    for text in ("", "\n", "a\nb", "é\n\n漢🙂\n", "x" * 10 + "\n" * 5):
        starts, ends = at.line_sections(text.encode())
        assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == text.split("\n")


def test_a_million_lines_take_seconds(spark):
    import time

    docs = spark.createDataFrame([(1, "word\n" * 1_000_000)], "doc_id int, text string")
    start = time.perf_counter()
    assert at.attributed(docs, BYTES, sections_column=None).count() == 1_000_002  # and the row of the line ends
    assert time.perf_counter() - start < 60
