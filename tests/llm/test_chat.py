import hashlib

import pytest

from hirelake.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, example string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def key(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or 0, row[2] or "")


def conversations(rows):
    made = {}
    for conv, _, role, text in sorted(rows, key=key):
        made.setdefault(conv, []).append((role or "", text or ""))
    return made


def by_hand(rows):
    made = []
    for conv, turns in conversations(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        made.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(made, key=repr)


def read(examples):
    return sorted((tuple(r)[:5] for r in chat.read_back(examples).collect()), key=repr)


def texts(examples):
    """(conv, example) -> (text, trainable text)."""
    made = {}
    for r in sorted(examples.collect(), key=lambda r: r["part"]):
        text, loss = made.get((r["conv_id"], r["example"]), ("", None))
        if r["loss_start"] is not None:
            assert r["part"] == r["parts"] - 1 and loss is None
            loss = r["text"][r["loss_start"]:r["loss_end"]]
        made[r["conv_id"], r["example"]] = (text + r["text"], loss)
    return made


def test_every_reply_is_an_example_with_its_context(spark):
    rows = [(5, 0, "system", "be brief"), (5, 1, "user", "hi"), (5, 2, "assistant", "yo"), (5, 3, "user", "more"),
            (5, 4, "assistant", "no"), (6, 0, "user", "alone"), (7, 0, "assistant", "first"), (7, 1, "user", "last")]
    head = "<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    first = head + "<|im_start|>assistant\nyo<|im_end|>\n"
    examples = chat.formatted(frame(spark, rows))
    assert texts(examples) == {
        (5, 0): (first, "yo"), (5, 1): (first + "<|im_start|>user\nmore<|im_end|>\n<|im_start|>assistant\nno<|im_end|>\n", "no"),
        (6, 0): ("<|im_start|>user\nalone<|im_end|>\n", None), (7, 0): ("<|im_start|>assistant\nfirst<|im_end|>\n", "first"),
        (7, 1): ("<|im_start|>assistant\nfirst<|im_end|>\n<|im_start|>user\nlast<|im_end|>\n", None)}
    assert {(r["conv_id"], r["example"]) for r in examples.where("whole").collect()} == {(5, 1), (6, 0), (7, 1)}
    assert read(examples) == by_hand(rows)


ODD = [(1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<\\|im_end|> <\\\\| <| <\\ < |"), (1, 2, "assistant", "<"),
       (2, 0, "us\ner%0A<|im_end|>%", "x\n<|im_end|>\n"), (2, 1, "assistant ", "role with a blank"), (2, 2, None, None), (2, None, "assistant", "é漢🙂\r\n\x85"),
       (None, 0, "assistant", "no id"), (None, 1, "user", None), (3, 0, "assistant", ""), (3, 1, "assistant", None), (3, 1, "user", "a tie"),
       (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (9, 0, "assistant", "z" * 200_000), (9, 1, "user", "after")]


@pytest.mark.parametrize("size", [1, 60, 1 << 16])
def test_odd_turns(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "BLOCK_CHARS", size)
    examples = chat.formatted(frame(spark, ODD))
    assert read(examples) == by_hand(ODD)
    for (conv, n), (text, loss) in texts(examples).items():
        if loss is not None:
            assert text.endswith(loss + chat.END + "\n") and chat.unescaped(loss) in [t or "" for c, _, _, t in ODD if c == conv]


def test_empty_table(spark):
    examples = chat.formatted(frame(spark, []))
    assert examples.count() == 0 and read(examples) == []


def test_a_long_conversation_over_many_tasks(spark, monkeypatch):
    """A third of all rows in one conversation, and rows that repeat."""
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(120)]
    rows += [(2, 0, "assistant", "again")] * 100 + [(i, t, r, "x") for i in range(10, 60) for t, r in enumerate(["user", "assistant"])]
    monkeypatch.setattr(chat, "BLOCK_CHARS", 200)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = frame(spark, rows)
        parts = chat.blocks_of(chat.segments(turns, "conv_id", "turn", "role", "text")).where("id <= 2")
        assert parts.select("id", "part").distinct().count() >= 6
        examples = chat.formatted(turns)
        assert read(examples) == by_hand(rows)
        made = texts(examples)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    said = conversations(rows)[1]
    whole = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in said)
    replies = [n for n, (r, _) in enumerate(said) if r == "assistant"]
    for n, at in enumerate(replies):
        text, loss = made[1, n]
        assert whole.startswith(text) and loss == f"turn {at}" and text.count(chat.START) == at + 1
    assert made[1, len(replies)] == (whole, None)
    assert sorted(n for c, n in made if c == 2) == list(range(100))


def test_probe_and_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    path = "/root/testdata/sf0.001/conversations.parquet"
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    got = chat.read_back(chat.formatted(chat.with_probe(spark.read.parquet(path)))).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(chat.SQL).fetchall())
    assert [r["n_turns"] for r in got if r["conv_id"] == -1] == [2]
