"""Secrets in whole texts: keyword automaton, anchored patterns at its hits, checksums inside tokens.

One Aho-Corasick pass over a text finds every keyword. A pattern is tried only where a keyword of its
kind begins, anchored there. Hex runs have no keyword; any run of three hex characters serves as one, as
a run of 16 begins with it. Kinds whose tokens carry a checksum keep only tokens that pass it.

Text is scanned as UTF-8 with A-Z lowered for the automaton only, so byte places stay the same; the
patterns, all ASCII, see the text as it is. Spans are given in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import string
import zlib
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from hirelake.llm.batches import map_slices

HEX_DIGITS = "0123456789abcdef"
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
# Fixed values of the bech32 checksum.
BECH32_POLYNOMIAL = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def base62_crc(match: re.Match) -> bool:
    """The last six characters are the base-62 CRC-32 of the characters before them."""
    body, given = match[1], match[2].decode()
    value, made = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        made = BASE62[digit] + made
    return made == given


def bech32_sound(match: re.Match) -> bool:
    """The checksum of a bech32 string holds."""
    prefix, data = match[1].decode().lower(), match[2].decode().lower()
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    state = 1
    for v in values:
        top = state >> 25
        state = (state & 0x1FFFFFF) << 5 ^ v
        for i, p in enumerate(BECH32_POLYNOMIAL):
            if top >> i & 1:
                state ^= p
    return state == 1


class Kind(NamedTuple):
    name: str
    keywords: tuple[str, ...]  # lower case
    pattern: re.Pattern  # begins with a keyword
    passes: Callable[[re.Match], bool]


KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
         lambda m: len(m[2]) >= 12),
    Kind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    Kind("hex", tuple(map("".join, itertools.product(HEX_DIGITS, repeat=3))),
         re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    # Tokens with a checksum of their own.
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
         re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), base62_crc),
    Kind("npm", ("npm_",), re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), base62_crc),
    Kind("age", ("age-secret-key-1",),
         re.compile(rb"(AGE-SECRET-KEY-)1([QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58})(?![A-Z0-9])"), bech32_sound),
)
BASE = ("assign", "access", "hex")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    kinds: dict[str, list[int]] = {}
    for i, kind in enumerate(KINDS):
        for word in kind.keywords:
            kinds.setdefault(word, []).append(i)
    made = ahocorasick.Automaton()
    for word, own in kinds.items():
        made.add_word(word, (len(word) - 1, tuple(own)))
    made.make_automaton()
    return made


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, by start, then kind.

    Of each kind the leftmost matches that do not overlap, without those that fail the kind's test.
    """
    data = text.encode("utf-8", "surrogatepass")
    tried: list[tuple[int, int]] = []
    for last, (back, own) in automaton().iter(data.lower().decode("latin-1")):
        for i in own:
            tried.append((last - back, i))
    if not tried:
        return []
    free = [0] * len(KINDS)
    found = []
    tried.sort()
    for start, i in tried:
        if start < free[i]:
            continue
        match = KINDS[i].pattern.match(data, start)
        if match:
            free[i] = match.end()
            if KINDS[i].passes(match):
                found.append((start, i, match.end()))
    if len(data) == len(text):
        return found
    # Byte places to code points, in one pass over the text.
    points, at, seen = {}, 0, 0
    for place in sorted({p for a, _, b in found for p in (a, b)}):
        seen += len(data[at:place].decode("utf-8", "surrogatepass"))
        points[place] = seen
        at = place
    return [(points[a], i, points[b]) for a, i, b in found]


def shown(found: list[tuple[int, int, int]], names: tuple[str, ...] | None = None) -> str:
    return ",".join(f"{KINDS[i].name}:{a}:{b}" for a, i, b in found if names is None or KINDS[i].name in names)


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, a count ``n_<kind>`` of every kind, ``base_sha256`` (of the spans of
    assign, access and hex), ``spans`` (kind:start:end of all kinds, comma-joined).

    A null or empty text has none: zero counts, empty ``spans``. Every row is scanned by itself, so null
    and repeated ids stay as they are. Columns other than the two named are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    counts = [f"n_{k.name}" for k in KINDS]
    schema = f"{id_column} {kind}, {', '.join(f'{c} bigint' for c in counts)}, base_sha256 string, spans string"

    def work(part: pa.RecordBatch) -> dict:
        all_found = [scan(t or "") for t in part["text"].to_pylist()]
        return {id_column: part["id"],
                **{c: [sum(f[1] == i for f in own) for own in all_found] for i, c in enumerate(counts)},
                "base_sha256": [hashlib.sha256(shown(own, BASE).encode()).hexdigest() for own in all_found],
                "spans": [shown(own) for own in all_found]}

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return map_slices(rows, "text", schema, work)


def masked(text: str, found: list[tuple[int, int, int]], mask: str = "[secret]") -> str:
    """The text with every stretch covered by spans replaced by one ``mask``."""
    parts, at = [], 0
    for start, _, end in found:
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mask]
        at = end
    return "".join(parts) + text[at:]


def without_secrets(docs: DataFrame, text_column: str = "text", count_column: str = "n_chars") -> DataFrame:
    """The rows with their secrets masked, and ``count_column`` (if there) set to the length of changed texts.

    All columns and rows stay; a null text stays null.
    """
    names = docs.columns
    at = names.index(text_column)
    counted = names.index(count_column) if count_column in names else None

    def run(batches):
        for part in batches:
            texts = part.column(at).to_pylist()
            changed = [t and ((found := scan(t)) and masked(t, found) or t) for t in texts]
            columns = list(part.columns)
            columns[at] = pa.array(changed, columns[at].type)
            if counted is not None:
                sizes = columns[counted].to_pylist()
                sizes = [len(b) if a != b else n for a, b, n in zip(texts, changed, sizes, strict=True)]
                columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
