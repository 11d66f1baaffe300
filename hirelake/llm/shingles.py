"""Word shingles of whole texts as 64-bit fingerprints, vectorised over slices of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from hirelake.llm.batches import offsets_of

FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * SECOND
    x = (x ^ (x >> np.uint64(29))) * FIRST
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space in a row, and how many each text has.

    A-Z count as a-z. A null text has no words.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    stops = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    counts = np.diff(np.concatenate([[0], before[stops]]))
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[coded.indices.to_numpy(zero_copy_only=False)[real]], counts


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Every text's distinct shingles of ``width`` words, sorted.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    words, counts = word_hashes(texts)
    folded = mixed(words)
    n = len(words)
    for i in range(1, width):
        if n > i:
            folded[:n - i] = mixed(folded[:n - i] * FIRST + words[i:])
    marks = offsets_of(counts)
    made = []
    for a, b in zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(folded[a:b - width + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            own = mixed(words[a:a + 1])
            for k in range(a + 1, b):
                own = mixed(own * FIRST + words[k:k + 1])
            own = mixed(own + np.uint64(b - a))
        else:
            own = words[:0]
        made.append(own)
    return made
