"""Tokens of whole documents attributed to fields or sections by their character spans.

Each document is encoded once. Its tokens' spans and its sections' spans meet in an interval join of
two sorted lists. A token that crosses a boundary goes to one section by the rule named:

``majority``  the section with most of its characters, the earlier one on a tie (default)
``start``     the section of its first character
``end``       the section of its last character

A token none of whose characters (first, last character) lies in a section goes to none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.batches import gather, map_slices, offsets_of
from hirelake.llm.tokens import Encoder, encoder

RULES = ("majority", "start", "end")
# The section of tokens that lie in none.
NONE = "none"


def line_sections(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of every line of a text in UTF-8, each without its line end, in one pass."""
    data = np.frombuffer(text, np.uint8)
    upto = np.cumsum(data & 0xC0 != 0x80)  # characters begun up to and with each byte
    breaks = upto[data == 0x0A] - 1
    return np.concatenate([[0], breaks + 1]), np.append(breaks, upto[-1] if len(data) else 0)


def sections_of(sizes: F.Column, name, between: int) -> F.Column:
    """(name, start, end) of parts of the given sizes with ``between`` characters from one to the next."""
    grown = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, n: F.struct((acc["at"] + n + between).alias("at"),
                                F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))
    return F.transform(
        F.arrays_zip(grown["starts"].alias("start"), sizes.alias("size")),
        lambda x, i: F.struct(name(i).alias("name"), x["start"].alias("start"),
                              (x["start"] + x["size"]).alias("end")))


def field_sections(docs: DataFrame, fields: list[str], between: str = "\n") -> DataFrame:
    """Adds ``text``, the named columns joined by ``between`` (null: empty), and their ``sections``."""
    values = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    names = F.array(*[F.lit(f) for f in fields])
    sections = sections_of(F.array(*[F.length(v) for v in values]),
                           lambda i: F.element_at(names, i.cast("int") + 1), len(between))
    return docs.withColumns({"text": F.concat_ws(between, *values), "sections": sections})


def spans(coder: Encoder, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of every token; a token of part of a character spans all of it."""
    ends = np.cumsum(coder.sizes[ids])
    opens = np.frombuffer(data, np.uint8) & 0xC0 != 0x80
    chars = np.cumsum(opens)  # characters begun up to and with each byte
    return chars[ends - coder.sizes[ids]] - 1, chars[ends - 1]


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray,
              rule: str = "majority") -> np.ndarray:
    """The number of the section of every token, -1 for none.

    Sections are sorted and do not overlap, so those a token touches are neighbours.
    """
    if not len(starts):
        return np.full(len(first), -1)
    if rule != "majority":
        at = first if rule == "start" else end - 1
        found = np.searchsorted(starts, at, side="right") - 1
        return np.where((found >= 0) & (at < ends[found]), found, -1)
    low = np.searchsorted(ends, first, side="right")  # the first section that ends after the token begins
    high = np.searchsorted(starts, end, side="left")  # the first that begins after the token
    n = np.maximum(high - low, 0)
    token = np.repeat(np.arange(len(first)), n)
    section = gather(low, n)
    shared = np.minimum(end[token], ends[section]) - np.maximum(first[token], starts[section])
    order = np.lexsort((section, -shared, token))
    order = order[shared[order] > 0]
    chosen, at = np.unique(token[order], return_index=True)
    made = np.full(len(first), -1)
    made[chosen] = section[order][at]
    return made


def attributed(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text",
               sections_column: str | None = "sections", rule: str = "majority") -> DataFrame:
    """One row per document and section: id, ``section`` (position from 0), ``name``, ``n_tokens``,
    ``n_crossing`` (of these, tokens that also hold characters outside), ``doc_tokens``.

    ``sections`` is an array of (name, start, end) in code points, end exclusive, sorted and without
    overlap; with None for their column they are the text's lines, the first named title and the others body. Tokens in
    none are counted under a row with a null ``section`` and the name ``none``,
    so a document's counts always add up to ``doc_tokens``. That row appears where there are such tokens,
    and for a document without sections. Null text or sections count as empty. Every row is a document
    of its own, also with a null or repeated id. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, section int, name string, n_tokens bigint, n_crossing bigint, doc_tokens bigint"

    def lines(texts: pa.Array):
        for text in texts:
            starts, ends = line_sections(text.as_buffer().to_pybytes())
            yield ["title"] + ["body"] * (len(starts) - 1), starts, ends

    def given(sections: pa.Array):
        listed = pc.fill_null(pc.list_value_length(sections), 0).to_numpy(zero_copy_only=False)
        fields = sections.flatten()
        names = fields.field("name").to_pylist()
        starts = fields.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = fields.field("end").to_numpy(zero_copy_only=False).astype(np.int64)
        marks = offsets_of(listed)
        for a, b in zip(marks[:-1], marks[1:], strict=True):
            yield names[a:b], starts[a:b], ends[a:b]

    def work(part: pa.RecordBatch) -> dict:
        coder = encoder(vocabulary)
        texts = pc.fill_null(part["text"], "")
        ids, counts = coder.encode(texts)
        own = np.split(ids, np.cumsum(counts)[:-1])
        made: dict[str, list] = {"section": [], "n_tokens": [], "n_crossing": []}
        rows, name, total = [], [], []
        for i, (names, starts, ends) in enumerate(lines(texts) if sections_column is None else given(part["sections"])):
            first, end = spans(coder, own[i], texts[i].as_buffer().to_pybytes()) if len(own[i]) else (own[i], own[i])
            found = attribute(first, end, starts, ends, rule)
            n = np.bincount(found + 1, minlength=len(starts) + 1)
            known = found >= 0
            over = np.zeros(len(found), bool)
            over[known] = (first[known] < starts[found[known]]) | (end[known] > ends[found[known]])
            cross = np.bincount(found[over] + 1, minlength=len(starts) + 1)
            shown = slice(0 if n[0] or not len(starts) else 1, None)
            for column, values in zip(made.values(), (np.arange(-1, len(starts)), n, cross), strict=True):
                column.append(values[shown])
            size = len(n[shown])
            rows.append(np.full(size, i))
            name += [NONE, *names][shown]
            total.append(np.full(size, len(found)))
        joined = {c: np.concatenate([np.zeros(0, np.int64), *v]) for c, v in (made | {"rows": rows, "total": total}).items()}
        section = pa.array(joined["section"], pa.int32(), mask=joined["section"] < 0)
        return {id_column: part["id"].take(pa.array(joined["rows"])), "section": section, "name": name,
                "n_tokens": joined["n_tokens"], "n_crossing": joined["n_crossing"], "doc_tokens": joined["total"]}

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"),
                       *[docs[c].alias("sections") for c in [sections_column] if c is not None])
    return map_slices(rows, "text", schema, work)
