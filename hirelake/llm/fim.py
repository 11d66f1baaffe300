"""Fill-in-middle transformation of whole texts, their cuts located over memoized chunks.

A text is a row of units: a word with the white space before it, or white space at the end. Two draws
from a document's hash say after how many units prefix and middle end. No list of units is made for it:

1. A rolling hash over the last 32 bytes cuts the text into chunks wherever its upper bits are zero, so a
   passage that several documents share is cut alike in all of them.
2. A chunk's summary is its number of characters, of word ends inside, and whether it begins and ends in
   a word. A worker keeps the summaries of chunks it has met under their whole content, so chunks are
   taken for equal only if they are, and each is read once.
3. Summaries combine: a word ends at a chunk's end if the chunk ends in a word and the next one does not
   begin in one. The running sum of word ends finds the chunk that a cut falls into; only that one is
   read again.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.batches import gather, map_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
# Percentages: of texts that are transformed, and of these that put the suffix first.
RATE = 50
SUFFIX_FIRST = 80

WINDOW = 32  # bytes the rolling hash sees
CHUNK_BITS = 9  # zero bits at a cut: 512 bytes a chunk on average
CHUNK_BYTES = 8192  # a longer chunk is cut here
RUN_BYTES = 4 << 20  # bytes hashed and summarised at a time
MEMO_BYTES = 48 << 20  # content a worker keeps before it starts anew

# A number for every byte, drawn by rule, and the bytes that are white space (20 and 09 to 0D).
GEAR = np.random.default_rng(WINDOW).integers(0, 1 << 32, 256, dtype=np.uint32)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def rolling(data: np.ndarray) -> np.ndarray:
    """At every byte a hash of it and the 31 bytes before: each counts shifted by its distance."""
    made = GEAR[data]
    reach = 1
    while reach < WINDOW:
        made[reach:] += made[:-reach] << np.uint32(reach)
        reach *= 2
    return made


def inner(data: np.ndarray) -> np.ndarray:
    """Whether each byte goes on with a character begun before."""
    return data & 0xC0 == 0x80


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of texts that lie one after the other; every text's end is one.

    No cut falls into a character. The hash of a text's first bytes has seen the text before, so none
    is made there.
    """
    found = []
    for start in range(0, len(data), RUN_BYTES):
        seen = max(0, start - WINDOW)
        hashes = rolling(data[seen:start + RUN_BYTES])[start - seen:]
        found.append(np.flatnonzero(hashes >> np.uint32(32 - CHUNK_BITS) == 0) + start + 1)
    marks = np.concatenate([np.zeros(0, np.int64), *found])
    marks = marks[marks < len(data)]
    marks = marks[~inner(data[marks])]
    starts = np.concatenate([[0], ends[:-1]])
    text = np.searchsorted(ends, marks, side="right")
    marks = marks[marks - starts[text] >= WINDOW]
    marks = np.unique(np.concatenate([marks, ends[ends > starts]]))
    sizes = np.diff(marks, prepend=0)
    begins = marks - sizes
    times = (sizes - 1) // CHUNK_BYTES
    more = np.repeat(begins, times) + CHUNK_BYTES * (gather(np.zeros(len(times), np.int64), times) + 1)
    for _ in range(3):  # back to the first byte of a character
        more = more - inner(data[more])
    return np.unique(np.concatenate([marks, more]))


def word_ends(data: np.ndarray) -> np.ndarray:
    """Places behind a word that is followed by white space."""
    space = SPACE[data]
    return np.flatnonzero(~space[:-1] & space[1:]) + 1


class Memo:
    """Summaries of chunks by their content."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.table = np.zeros((4, 0), np.int64)  # characters, word ends inside, begins and ends in a word

    def summaries(self, data: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The four numbers of every chunk."""
        content = memoryview(data)
        made = []
        at = 0
        while at < len(marks):
            begin = int(marks[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(marks, begin + RUN_BYTES, side="right")))
            bounds = [begin, *marks[at:stop].tolist()]
            made.append(self._known([bytes(content[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]))
            at = stop
        return np.concatenate([np.zeros((4, 0), np.int64), *made], axis=1)

    def _known(self, chunks: list[bytes]) -> np.ndarray:
        if self.held > MEMO_BYTES:
            self.clear()
        first = len(self.index)
        new = []
        for chunk in chunks:
            if chunk not in self.index:
                self.index[chunk] = first + len(new)
                new.append(chunk)
        if new:
            self.held += sum(map(len, new))
            self.table = np.concatenate([self.table, summarised(new)], axis=1)
        return self.table[:, [self.index[chunk] for chunk in chunks]]


def summarised(chunks: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(chunks), np.uint8)
    stops = np.cumsum([len(c) for c in chunks])
    starts = stops - [len(c) for c in chunks]
    space = SPACE[data]
    ending = np.zeros(len(data), bool)
    ending[:-1] = ~space[:-1] & space[1:]
    ending[stops - 1] = False
    return np.stack([np.add.reduceat(~inner(data), starts, dtype=np.int64), np.add.reduceat(ending, starts, dtype=np.int64),
                     ~space[starts], ~space[stops - 1]])


@lru_cache(maxsize=1)
def memo() -> Memo:
    """One per worker."""
    return Memo()


class Located:
    """Units of texts that lie one after the other, and places between them."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data, self.ends = data, ends
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.marks = cuts(data, ends)
        chars, ending, begins, stops = memo().summaries(data, self.marks)
        last = np.isin(self.marks, ends)  # the last chunk of its text
        follows = np.concatenate([begins[1:], [0]]) > 0
        words = ending + ((stops > 0) & (last | ~follows))
        self.inside = ending
        self.words = np.concatenate([[0], np.cumsum(words)])
        self.chars = np.concatenate([[0], np.cumsum(chars)])
        # Chunks before each text, and behind it.
        self.first = np.searchsorted(self.marks, self.starts, side="right")
        self.stop = np.searchsorted(self.marks, ends, side="right")
        self.n_words = self.words[self.stop] - self.words[self.first]
        filled = ends > self.starts
        self.n = self.n_words + (filled & (len(data) > 0) & SPACE[data[np.maximum(ends, 1) - 1] if len(data) else ends])

    def place(self, text: int, units: int) -> tuple[int, int]:
        """Byte and character, counted from the text's start, behind its first so many units."""
        start, before = int(self.starts[text]), int(self.chars[self.first[text]])
        if units > self.n_words[text]:
            return int(self.ends[text]) - start, int(self.chars[self.stop[text]]) - before
        if not units:
            return 0, 0
        wanted = int(self.words[self.first[text]]) + units
        chunk = int(np.searchsorted(self.words, wanted, side="left")) - 1
        begin = int(self.marks[chunk - 1]) if chunk else 0
        inside = wanted - int(self.words[chunk])
        if inside > self.inside[chunk]:
            return int(self.marks[chunk]) - start, int(self.chars[chunk + 1]) - before
        content = self.data[begin:int(self.marks[chunk])]
        at = int(word_ends(content)[inside - 1])
        return begin + at - start, int(self.chars[chunk]) - before + int((~inner(content[:at])).sum())


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])
    if form == "spm":
        return b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    return prefix + middle + suffix


def restored(form: str, output: bytes) -> bytes:
    """The text that an output was made of. Transformed texts hold no mark, so each mark is found where it was put."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, two = output.index(second, len(first)), output.index(MIDDLE, len(first))
    parts = output[len(first):one], output[one + len(second):two]
    prefix, suffix = parts if form == "psm" else parts[::-1]
    return prefix + output[two + len(MIDDLE):] + suffix


def transformed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED,
                rate: int = RATE, suffix_first: int = SUFFIX_FIRST, digests_only: bool = False) -> DataFrame:
    """One row per document: the id column, ``n`` units, ``form`` (``plain``, ``psm`` prefix first, ``spm`` suffix
    first), ``prefix_chars`` and ``middle_chars`` (null if plain), ``output_sha256``, ``restored_sha256`` of the
    text rebuilt from the output, and unless ``digests_only`` the ``output`` itself.

    The draws are the first four groups of eight hex digits of the sha256 of ``seed:id``; ``rate`` and ``suffix_first``
    are percentages. Empty texts and texts that hold a mark stay plain. A null text counts as empty, a null id as
    an empty one. Every row is a document of its own, also with a repeated id, and rows with an id in common are
    cut at the same draws. Other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, "
              "restored_sha256 string") + ("" if digests_only else ", output string")

    def work(part: pa.RecordBatch) -> dict:
        texts = pc.fill_null(part["text"], "").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0]:bounds[-1]] if bounds[-1] > bounds[0] \
            else np.zeros(0, np.uint8)
        units = Located(data, (bounds - bounds[0])[1:])
        held = memoryview(data)
        made: dict[str, list] = {f: [] for f in ("form", "prefix_chars", "middle_chars", "output_sha256",
                                                 "restored_sha256", "output")}
        for i, draws in enumerate(part["draws"].to_pylist()):
            text = bytes(held[int(units.starts[i]):int(units.ends[i])])
            one, two, three, four = (int(draws[k:k + 8], 16) for k in range(0, 32, 8))
            form = "spm" if four % 100 < suffix_first else "psm"
            low, high, chars = 0, 0, (None, None)
            if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or three % 100 >= rate:
                form = "plain"
            else:
                n = int(units.n[i]) + 1
                (low, before), (high, upto) = (units.place(i, k) for k in sorted((one % n, two % n)))
                chars = before, upto - before
            output = arranged(form, text[:low], text[low:high], text[high:])
            digest = hashlib.sha256(restored(form, output)).hexdigest()
            for name, value in zip(made, (form, *chars, hashlib.sha256(output).hexdigest(), digest,
                                          None if digests_only else output.decode()), strict=True):
                made[name].append(value)
        return made | {"id": part["id"], "n": units.n}

    key = F.coalesce(docs[id_column].cast("string"), F.lit(""))
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"),
                       F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256).alias("draws"))
    return map_slices(rows, "text", schema, work).withColumnRenamed("id", id_column)


SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id::VARCHAR) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::UBIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::UBIGINT % (len(units) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR ('0x' || h[17:24])::UBIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::UBIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(units[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
