"""Whole texts to token ids, each distinct word encoded once.

Both vocabularies cut a text where a character that is no white space is followed by white space:
no pattern of their pre-tokenizers reaches over that point. A text's ids are therefore its
words' ids in a row, and a worker keeps the ids of words it has met. For a vocabulary that drops
white space, words are cut and looked up many at once, and only new ones become Python strings.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hirelake.llm.batches import gather, offsets_of

# What a worker keeps of words and their ids before it starts anew, in bytes, by a rough count of what an
# entry takes; words longer than this are not kept, so text without white space fills nothing.
MEMO_BYTES = 64 << 20
ENTRY_BYTES = 200
WORD_CHARS = 64
# The same for words of a vocabulary that drops white space, in bytes as they lie in arrays.
KNOWN_BYTES = 24 << 20
# New words whose tokens are Python objects at once.
NEW_WORDS = 1024
# Words whose pre-tokens are plain to see: letters, then signs. Everything else takes the library's
# whole path.
PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*%&$#|]*)")
LOW_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
# What a byte of a text stands for, and the byte in lower case. À to ÿ are two bytes, of which C3 is the first.
SPACE, LETTER, SIGN, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[list(b"\t\n\v\f\r ")] = SPACE
KINDS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
KINDS[list(b".,;:!?*%&$#|")] = SIGN
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
# A place between a character that is surely no white space and white space.
CUT = re.compile(r"(?<=[\w!-~])(?=[ \n])")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others follow from 256 upwards.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def plain_parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, and how many each text has.

    Plain words are in lower case, their signs a word of their own; other words stay as they are.
    """
    none = pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    texts = texts.cast(pa.string())
    if not len(texts):
        return none
    marks = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    if marks[0] == marks[-1]:
        return none
    raw = np.frombuffer(texts.buffers()[2], np.uint8, marks[-1] - marks[0], marks[0])
    marks -= marks[0]
    kinds, low = KINDS[raw], LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # no × and ÷
    kinds[lead] = kinds[lead + 1] = LETTER
    low[lead + 1] += (raw[lead + 1] < 0x9F) * np.uint8(0x20)
    inside = kinds != SPACE
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    begins = marks[:-1][marks[:-1] < len(raw)]
    head[begins] = inside[begins]
    marks -= np.searchsorted(np.flatnonzero(~inside), marks)
    # From here on without white space.
    kinds, low, raw, head = kinds[inside], low[inside], raw[inside], head[inside]
    heads = np.flatnonzero(head)
    if not len(heads):
        return none
    sign = kinds == SIGN
    odd = (kinds == OTHER) | (sign & head)
    odd[1:] |= sign[:-1] & (kinds[1:] == LETTER) & ~head[1:]
    odd = np.repeat(np.logical_or.reduceat(odd, heads), np.diff(np.append(heads, len(head))))
    head[1:] |= sign[1:] & ~sign[:-1] & ~odd[1:]
    low = np.where(odd, raw, low)
    starts = np.flatnonzero(head)
    words = pa.Array.from_buffers(pa.string(), len(starts), [
        None, pa.py_buffer(np.append(starts, len(low)).astype(np.int32)), pa.py_buffer(low)])
    return words, np.diff(np.searchsorted(starts, marks))


class Encoder:
    """Ids of texts under one vocabulary file; ``spaces`` tells whether its tokens hold white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spaces = self.tokenizer.normalizer is None
        self.letters = byte_letters()
        self.inner_letters = {b: c for b, c in self.letters.items() if b != ord("\n")}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.flat = array("q", [0]), array("I")
        self.parts: dict[str, list[int]] = {}
        self.held = 0
        self.known, self.known_ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.known_starts = np.zeros(1, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def part(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        found = self.parts.get(text)
        if found is None:
            spelled = text.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.tokenizer.model.tokenize(spelled)]
            if len(text) <= WORD_CHARS:
                self.parts[text] = found
                self.held += ENTRY_BYTES + len(text) + 32 * len(found)
        return found

    def word(self, text: str) -> list[int]:
        plain = PLAIN.fullmatch(text)
        if plain is None:
            return self.whole(text)
        lead, letters, signs = plain.groups()
        if lead == "\n":
            ids = self.part("\n") + self.part(letters)
        else:
            ids = self.part(lead + letters)
        return ids + self.part(signs) if signs else ids

    def entry(self, word: str) -> int:
        """Where the word's ids are, until the next call of :meth:`encode` or for longer."""
        found = self.index.get(word)
        if found is None:
            found = len(self.starts) - 1
            ids = self.word(word)
            self.flat.extend(ids)
            self.starts.append(len(self.flat))
            if len(word) <= WORD_CHARS:
                self.index[word] = found
                self.held += ENTRY_BYTES + len(word)
            self.held += 4 * len(ids) + 8
        return found

    def entries(self, words: list[str]) -> np.ndarray:
        """:meth:`entry` of many words."""
        found = list(map(self.index.get, words))
        for i, at in enumerate(found):
            if at is None:
                found[i] = self.entry(words[i])
        return np.array(found, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null: empty), and how many each text has."""
        texts = pc.fill_null(texts, "")
        if self.spaces:
            if self.held > MEMO_BYTES:
                self.clear()
            entries, counts = self._spaced(texts)
            starts = np.frombuffer(self.starts, dtype=np.int64)
            flat = np.frombuffer(self.flat, dtype=np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        else:
            words, counts = plain_parts(texts)
            coded = words.dictionary_encode()
            known, starts, flat = self._known(coded.dictionary)
            entries, codes = known, coded.indices.to_numpy(zero_copy_only=False)
        first = starts[entries]
        lengths = starts[entries + 1] - first
        if not self.spaces:
            first, lengths = first.take(codes), lengths.take(codes)
        ids = flat[gather(first, lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        stops = np.cumsum(counts)
        return ids, ends[stops] - ends[stops - counts]

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words, as :func:`plain_parts` cuts them: the entry of each, entries' starts, ids.

        Past the limit a worker keeps the words of this call only, or none if they alone are too many.
        """
        found = pc.index_in(words, value_set=self.known)
        missing = found.is_null().to_numpy(zero_copy_only=False)
        new = words.filter(found.is_null())
        ids, lengths = self._new(new.to_pylist())
        entries = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        entries[missing] = len(self.known) + np.arange(len(new))
        starts = np.concatenate([self.known_starts, self.known_starts[-1] + np.cumsum(lengths)])
        flat = np.concatenate([self.known_ids, ids])
        if self.known.nbytes + new.nbytes + starts.nbytes + flat.nbytes <= KNOWN_BYTES:
            self.known = pa.concat_arrays([self.known, new])
            self.known_starts, self.known_ids = starts, flat
        else:
            self.clear()
            first, lengths = starts[entries], np.diff(starts)[entries]
            if words.nbytes + 8 * len(words) + 4 * int(lengths.sum()) <= KNOWN_BYTES:
                self.known = words
                self.known_starts, self.known_ids = offsets_of(lengths), flat[gather(first, lengths)]
        return entries, starts, flat

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each has."""
        flat, lengths = array("I"), []
        tokenize = self.tokenizer.model.tokenize
        for a in range(0, len(words), NEW_WORDS):
            some = words[a:a + NEW_WORDS]
            spelled = "\n".join(some).encode().decode("latin-1").translate(self.inner_letters).split("\n")
            made = [tokenize(s) if LOW_LETTERS.fullmatch(w) else self.whole(w)
                    for w, s in zip(some, spelled, strict=True)]
            flat.extend([t if type(t) is int else t.id for part in made for t in part])
            lengths.extend(map(len, made))
        return np.array(flat, np.uint32), np.array(lengths, np.int64)

    def _spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words with the white space before them; texts with longer white space are cut one by one."""
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        stops = np.cumsum(counts)
        heads = stops - counts
        coded = pieces.flatten().dictionary_encode()
        spelled = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        known = self.entries([p if p[:1] == "\n" else " " + p for p in spelled])
        for i, piece in enumerate(spelled):
            inner = piece[1:] if piece[:1] == "\n" else piece
            if not inner or inner[0].isspace() or inner[-1].isspace():
                known[i] = -1
        entries = known[codes]
        nothing = self.entry("")
        odd = set()
        for row, at in enumerate(heads):  # a text's first piece has no space before it
            head = spelled[codes[at]]
            if head and head[-1].isspace():
                odd.add(row)
            entries[at] = self.entry(head) if head else nothing
        bad = np.flatnonzero(entries < 0)
        odd.update(np.searchsorted(stops, bad, side="right").tolist())
        if not odd:
            return entries, counts
        parts, kept = [], []
        for row in range(len(counts)):
            if row in odd:
                cut = CUT.split(texts[row].as_py())
                part = self.entries(cut)
            else:
                part = entries[heads[row]:stops[row]]
            parts.append(part)
            kept.append(len(part))
        return np.concatenate(parts), np.array(kept, np.int64)

    @property
    def spellings(self) -> list[bytes]:
        """The bytes of every id (of a vocabulary with ``spaces``)."""
        if not hasattr(self, "_spellings"):
            back = {ord(c): b for b, c in self.letters.items()}
            made = []
            for i in range(self.tokenizer.get_vocab_size()):
                token = self.tokenizer.id_to_token(i) or ""
                plain = token not in self.specials and all(ord(c) in back for c in token)
                made.append(bytes(back[ord(c)] for c in token) if plain else token.encode())
            self._spellings = made
            self._sizes = np.array([len(s) for s in made], np.int64)
        return self._spellings

    @property
    def sizes(self) -> np.ndarray:
        """Bytes of every id."""
        return self._sizes if self.spellings else np.zeros(0, np.int64)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    return Encoder(path)
