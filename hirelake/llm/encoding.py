"""BPE encoding and decoding by tree concatenation.

A text is halved until the parts are leaves of bounded length, wherever the cut falls. All leaves
are encoded independently. Going up the tree, the ids of two neighbours are joined by encoding a
window around the join anew: it reaches some tokens into either side and doubles until its first
and last tokens are those the sides have there. From such a place on both sides go on as one text,
as a token sequence is the encoding of its text if every two neighbouring tokens are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hirelake.llm.batches import map_slices
from hirelake.llm.tokens import Encoder, encoder

LEAF_CHARS = 2048
WINDOW_TOKENS = 4
AGREEING = 2


def halves(text: str, specials: list[str], leaf: int = LEAF_CHARS) -> list:
    """A tree of halves: leaves are strings, nodes pairs. No cut falls into a special token."""
    if len(text) <= max(leaf, 2):
        return [text]
    middle = outside(text, len(text) // 2, specials)
    if middle in (0, len(text)):
        return [text]
    return [halves(text[:middle], specials, leaf), halves(text[middle:], specials, leaf)]


def outside(text: str, at: int, specials: list[str]) -> int:
    """The nearest place from ``at`` on that lies in no special token."""
    for special in specials:
        reach = len(special) - 1
        found = text.find(special, max(0, at - reach), at + reach)
        if 0 <= found < at:
            return found + len(special)
    return at


def leaves(tree: list) -> list[str]:
    return tree if len(tree) == 1 else leaves(tree[0]) + leaves(tree[1])


def join(coder: Encoder, left: np.ndarray, right: np.ndarray, left_text: bytes, right_text: bytes,
         window: int = WINDOW_TOKENS) -> np.ndarray:
    """Ids of ``left_text + right_text`` from the ids of both."""
    if not len(left) or not len(right):
        return right if not len(left) else left
    left_ends, right_ends = np.cumsum(coder.sizes[left]), np.cumsum(coder.sizes[right])
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        while a and left_text[start := int(left_ends[a - 1])] & 0xC0 == 0x80:
            a -= 1
        start = int(left_ends[a - 1]) if a else 0
        while b < len(right) and right_text[int(right_ends[b - 1])] & 0xC0 == 0x80:
            b += 1
        stop = int(right_ends[b - 1])
        made = np.array(coder.whole((left_text[start:] + right_text[:stop]).decode()), np.uint32)
        same_left = not a or np.array_equal(made[:AGREEING], left[a:a + AGREEING])
        same_right = b == len(right) or np.array_equal(made[-AGREEING:], right[b - AGREEING:b])
        if same_left and same_right:
            return np.concatenate([left[:a], made, right[b:]])
        window *= 2


def grow(coder: Encoder, tree: list, ids: list[np.ndarray]) -> tuple[np.ndarray, bytes]:
    """Ids and bytes of a tree; takes its leaves' ids from the front of ``ids``."""
    if len(tree) == 1:
        return ids.pop(0), tree[0].encode()
    left, left_text = grow(coder, tree[0], ids)
    right, right_text = grow(coder, tree[1], ids)
    return join(coder, left, right, left_text, right_text), left_text + right_text


def encode_texts(coder: Encoder, texts: list[str], leaf: int = LEAF_CHARS) -> list[np.ndarray]:
    trees = [halves(t, coder.specials, leaf) for t in texts]
    parts = [leaves(t) for t in trees]
    flat, counts = coder.encode(pa.array([p for own in parts for p in own], pa.string()))
    pieces = np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []
    made, at = [], 0
    for tree, own in zip(trees, parts, strict=True):
        made.append(grow(coder, tree, pieces[at:at + len(own)])[0])
        at += len(own)
    return made


def decode_ids(coder: Encoder, ids: np.ndarray) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    spelled = coder.spellings
    return b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encoded(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text",
            leaf: int = LEAF_CHARS, digests_only: bool = False) -> DataFrame:
    """Ids and decoded text of every row: the id column, ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256``, and unless ``digests_only`` also ``ids`` and ``decoded``.

    A null text counts as empty: no ids, empty decoded text. A null or repeated id stays as it is,
    each row gives one row. Columns other than the two named are not read, whatever their names.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if not digests_only:
        schema += ", ids array<bigint>, decoded string"

    def work(part: pa.RecordBatch) -> dict:
        coder = encoder(vocabulary)
        texts = [t or "" for t in part["text"].to_pylist()]
        ids = encode_texts(coder, texts, leaf)
        decoded = [decode_ids(coder, i) for i in ids]
        made = {"id": part["id"], "n_tokens": [len(i) for i in ids],
                "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded]}
        return made if digests_only else made | {"ids": [i.tolist() for i in ids], "decoded": decoded}

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return map_slices(rows, "text", schema, work).withColumnRenamed("id", id_column)
