import hashlib
import random
import re

import numpy as np
import pytest

from hirelake.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text, rate=50, suffix_first=80):
    text = text or ""
    units = UNITS.findall(text)
    draws = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(draws[i:i + 8], 16) for i in range(0, 32, 8))
    low, high = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or three % 100 >= rate:
        form, output = "plain", text
    elif four % 100 < suffix_first:
        form, output = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, output = "psm", f"<P>{p}<S>{s}<M>{m}"
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, len(units), form, *sizes, hashlib.sha256(output.encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(), output)


def made(docs, **options):
    return sorted((tuple(r) for r in fim.transformed(docs, **options).collect()), key=repr)


def test_odd_documents(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert made(odd_docs) == sorted((by_hand(*r) for r in rows), key=repr)
    assert made(odd_docs, rate=100, suffix_first=0) == sorted((by_hand(*r, 100, 0) for r in rows), key=repr)
    assert made(no_docs) == []


def test_marks_in_texts_and_at_their_edges(spark):
    texts = ["a <P> b", "<S>", "<", "a < P> <", "x<P", "S> y", "a <M", "> b <M", "P><P <S"] * 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert made(docs, rate=100) == sorted((by_hand(i, t, 100) for i, t in enumerate(texts)), key=repr)


def located(texts):
    raw = [t.encode() for t in texts]
    return fim.Located(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))


@pytest.mark.parametrize("bits,longest,run", [(9, 8192, 4 << 20), (2, 16, 50), (4, 40, 300)])
def test_every_place(monkeypatch, bits, longest, run):
    monkeypatch.setattr(fim, "CHUNK_BITS", bits)
    monkeypatch.setattr(fim, "CHUNK_BYTES", longest)
    monkeypatch.setattr(fim, "RUN_BYTES", run)
    draw = random.Random(5)
    texts = ["".join(draw.choice(["a", "é", "漢", "🙂", " ", "\n", "\t ", "word", "\x1c", "\x85"]) for _ in range(draw.randrange(200)))
             for _ in range(60)] + ["", "a" * 500, " " * 500, "漢" * 300]
    units = located(texts)
    for i, text in enumerate(texts):
        pieces = UNITS.findall(text)
        assert units.n[i] == len(pieces)
        for k in range(len(pieces) + 1):
            head = "".join(pieces[:k])
            assert units.place(i, k) == (len(head.encode()), len(head))


def test_chunks_are_bounded_and_cut_between_characters():
    text = "漢" * 20_000 + "a" * 20_000
    data = np.frombuffer(text.encode(), np.uint8)
    marks = fim.cuts(data, np.array([len(data)]))
    assert np.diff(np.concatenate([[0], marks])).max() <= fim.CHUNK_BYTES + 3
    assert not fim.inner(data[marks[:-1]]).any() and marks[-1] == len(data)


def test_shared_passages_are_read_once(monkeypatch):
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(500)]
    shared = " ".join(draw.choices(words, k=4000))
    texts = [" ".join(draw.choices(words, k=20 + i)) + " " + shared for i in range(12)]
    monkeypatch.setattr(fim, "memo", lambda kept=fim.Memo(): kept)
    read = []
    plain = fim.summarised
    monkeypatch.setattr(fim, "summarised", lambda chunks: read.append(sum(map(len, chunks))) or plain(chunks))
    for text in texts:
        assert located([text]).n[0] == len(UNITS.findall(text))
    assert sum(read) < 3 * len(shared)


def test_equal_hashes_do_not_make_chunks_equal(monkeypatch):
    """Every byte is a cut; chunks of one hash still are told apart by their content."""
    monkeypatch.setattr(fim, "GEAR", np.zeros(256, np.uint32))
    texts = ["a b" * 50, "ab " * 50, "  b" * 50]
    assert located(texts).n.tolist() == [len(UNITS.findall(t)) for t in texts]


def test_the_memo_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(fim, "MEMO_BYTES", 1000)
    monkeypatch.setattr(fim, "RUN_BYTES", 2000)
    kept = fim.Memo()
    monkeypatch.setattr(fim, "memo", lambda: kept)
    draw = random.Random(7)
    texts = [" ".join("".join(draw.choices("abcdefgh", k=4)) for _ in range(400)) for _ in range(10)]
    assert located(texts).n.tolist() == [400] * 10
    assert kept.held < 5000
