"""Quality rules with risk-controlled cutoffs.

Every text gets a few measures. A rule rejects texts whose measure is above a cutoff. Cutoffs are
chosen on a labelled holdout, per stratum, so that good documents are falsely rejected at a rate
of at most ``ALPHA`` by all rules together, with confidence 1 - ``DELTA`` for all strata together:

* the confidence is shared out over the strata (Bonferroni);
* the candidates are the steps of ``LADDER``, each a cutoff for some of the rules. Every step tightens one
  rule, so what a step rejects, all later ones reject too. Steps are fixed before looking at data and tested in
  order, ending with the first that fails (fixed-sequence testing, so they need no further correction);
* a step passes if the exact binomial probability of as few good documents rejected by any of its rules,
  were the true rate the limit, is at most the stratum's share of ``DELTA``: the Clopper-Pearson upper bound is
  then within the limit.

A stratum without a passing step rejects nothing, as with too few labels: with no false rejection at all, 194
good documents are enough for five strata.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate
from types import MappingProxyType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.batches import as_array, offsets_of, slices
from hirelake.llm.minhash import picked
from hirelake.session import staged

ALPHA = 0.02
DELTA = 0.1
STRATA = ("en", "de", "fr", "es")
OTHER = "other"
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

# Candidate cutoffs by rule, mildest first. Those of repeated_words lie below the base rule's 0.3, at which it could reject nothing.
CANDIDATES: dict[str, tuple[float, ...]] = {
    "symbols_per_char": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "exclamations_per_word": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3),
    "repeated_lines": (0.9, 0.8, 0.7, 0.6, 0.5),
    "repeated_words": (0.25, 0.2, 0.15, 0.1),
    "capitals_per_char": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4),
}

UNION = "all rules"
Step = dict[str, float]


def ladder(candidates: dict[str, tuple[float, ...]], last: tuple[str, ...] = ()) -> tuple[Step, ...]:
    """Nested steps, mildest first: level by level one rule after the other, the rules in ``last`` after all others."""
    steps: list[Step] = []
    for group in ([r for r in candidates if r not in last], last):
        for level in range(max((len(candidates[r]) for r in group), default=0)):
            for rule in group:
                if level < len(candidates[rule]):
                    steps.append({**(steps[-1] if steps else {}), rule: candidates[rule][level]})
    return tuple(steps)


# repeated_words is last: the base rule stands for its milder candidates.
LADDER = ladder(CANDIDATES, ("repeated_words",))

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, " \
    "n_exclamations bigint, n_capitals bigint, n_lines bigint"


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns of ``MEASURES`` for every text; null counts as empty."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    stops = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)

    def summed(values: np.ndarray) -> np.ndarray:
        grown = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return grown[stops] - grown[starts]

    counts = summed(real)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)[real]
    marks = offsets_of(counts)
    repeated = np.array([repeated_words(codes[a:b]) for a, b in zip(marks[:-1], marks[1:], strict=True)], np.int64)
    dup_lines, lines = duplicate_lines(texts)
    return {
        "n_words": counts,
        "word_chars": summed(pc.utf8_length(flat).to_numpy(zero_copy_only=False)),
        "n_symbols": counted(texts, SYMBOLS), "n_dup_lines": dup_lines, "n_repeat_words": repeated,
        "n_exclamations": counted(texts, "!"), "n_capitals": counted(texts, r"\p{Lu}"), "n_lines": lines,
    }


def counted(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of eight words found twice or more in the text.

    Windows are compared exactly: pairs, then fours, then eights are numbered by their distinct values.
    """
    n = len(codes) - window + 1
    if n < 2:
        return 0
    names = codes.astype(np.int64)
    width = 1
    while width < window:
        pairs = names[:len(names) - width] << 32 | names[width:]
        ordered = np.sort(pairs)
        if width * 2 == window or (ordered[1:] != ordered[:-1]).all():
            break  # all distinct: so are the longer ones
        names = np.searchsorted(ordered, pairs)
        width *= 2
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again) or width * 2 != window:
        return 0
    at = np.searchsorted(again, pairs)
    at[at == len(again)] = 0
    hit = np.flatnonzero(again[at] == pairs)
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line; lines with a word."""
    split = pc.split_pattern(texts, "\n")
    flat = split.flatten()
    n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    coded = flat.dictionary_encode()
    worded = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = worded[codes]
    lines = np.bincount(row[keep], minlength=len(n))
    distinct = np.unique(row[keep] << 32 | codes[keep])
    return lines - np.bincount(distinct >> 32, minlength=len(n)), lines


def free_name(docs: DataFrame, name: str = "_measures") -> str:
    """The name, or one made from it that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_measures(docs: DataFrame, text_column: str = "text", out: str = "_measures") -> DataFrame:
    """``docs`` with one more column, the struct ``out``; all columns and rows stay."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StructType.fromDDL(MEASURES))])
    names = docs.columns
    at = names.index(text_column)

    def run(batches):
        for part in slices(batches, at):
            made = {n: as_array(v, pa.int64()) for n, v in measures(part.column(at)).items()}
            struct = pa.StructArray.from_arrays(list(made.values()), list(made))
            yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*names, out])

    return docs.mapInArrow(run, schema)


def base_failed(m: str = "_measures") -> Column:
    return (F.col(f"{m}.n_words") < 20) | (100 * F.col(f"{m}.n_repeat_words") > 30 * F.col(f"{m}.n_words"))


def scores(m: str = "_measures") -> dict[str, Column]:
    """The rules' measures; 0 for texts without words."""
    def ratio(a: str, b: str) -> Column:
        over = F.col(f"{m}.{b}")
        return F.when(over > 0, F.col(f"{m}.{a}") / over).otherwise(0.0)

    return {"symbols_per_char": ratio("n_symbols", "word_chars"),
            "exclamations_per_word": ratio("n_exclamations", "n_words"),
            "repeated_lines": ratio("n_dup_lines", "n_lines"),
            "repeated_words": ratio("n_repeat_words", "n_words"),
            "capitals_per_char": ratio("n_capitals", "word_chars")}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most ``k`` of ``n``) at rate ``p``, by summing exact terms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p)
            + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate at which ``k`` or fewer of ``n`` have a chance of ``level``."""
    if k >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_tail(k, n, middle) > level else (low, middle)
    return high


@dataclass(frozen=True)
class Cutoff:
    stratum: str
    rule: str
    cutoff: Step | float
    good: int
    rejected: int
    bound: float


def select_cutoffs(counts: dict[str, tuple[int, dict[str, list[int]]]], alpha: float = ALPHA, delta: float = DELTA,
                   candidates: Mapping[str, Sequence[Step | float]] = MappingProxyType({UNION: LADDER})) -> list[Cutoff]:
    """The strictest certified candidate of each sequence.

    ``counts``: for each stratum the good documents and, by sequence, how many of them each candidate rejects.
    Several sequences share ``alpha`` and ``delta``.
    """
    limit = alpha / len(candidates)
    level = delta / (len(candidates) * max(1, len(counts)))
    made = []
    for stratum, (good, rejected) in sorted(counts.items()):
        for rule, cutoffs in candidates.items():
            passed = None
            for cutoff, k in zip(cutoffs, rejected[rule], strict=True):
                if not good or binomial_tail(k, good, limit) > level:
                    break
                passed = Cutoff(stratum, rule, cutoff, good, k, upper_bound(k, good, level))
            if passed:
                made.append(passed)
    return made


def stratum_of(column: str, strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(F.col(column).isin(*strata), F.col(column)).otherwise(OTHER)


def first_step(steps: Sequence[Step] = LADDER, m: str = "_measures") -> Column:
    """The number of the first step that rejects a row; that of no step if none does."""
    tightened = [next((r, c) for r, c in step.items() if at == 0 or steps[at - 1].get(r) != c)
                 for at, step in enumerate(steps)]
    score = scores(m)
    return F.coalesce(*[F.when(score[rule] > cutoff, at) for at, (rule, cutoff) in enumerate(tightened)],
                      F.lit(len(steps)))


def holdout_counts(measured: DataFrame, labels: DataFrame, id_column: str, stratum_column: str,
                   strata: tuple[str, ...], mark_column: str) -> dict[str, tuple[int, dict[str, list[int]]]]:
    """Counts for :func:`select_cutoffs` of good labelled documents that pass the base rule.

    Good: at least one label, all of quality 1. Trials have to be independent, so equal texts (by ``mark_column``) count once,
    and so does an id that several rows share. One row per stratum and step reaches the driver.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1")
    rows = measured.where(~base_failed()).join(good, measured[id_column] == good["doc_id"], "left_semi")
    trials = rows.select(F.col(id_column).alias("_id"), F.col(mark_column).alias("_mark"),
                         F.struct(stratum_of(stratum_column, strata).alias("s"), first_step().alias("step")).alias("_t"))
    texts = trials.groupBy("_mark").agg(F.min(F.struct("_id", "_t")).alias("_first"))
    distinct = texts.groupBy("_first._id").agg(F.min("_first._t").alias("_t"))
    found = distinct.groupBy(F.col("_t.s").alias("_s"), F.col("_t.step").alias("_step")).agg(F.count("*").alias("_n")).collect()
    first = {s: [0] * (len(LADDER) + 1) for s in (*strata, OTHER)}
    for r in found:
        first[r["_s"]][r["_step"]] = r["_n"]
    return {s: (sum(n), {UNION: list(accumulate(n[:-1]))}) for s, n in first.items()}


def rejected_by(cutoffs: list[Cutoff], stratum_column: str, strata: tuple[str, ...] = STRATA, m: str = "_measures") -> Column:
    """True where a rule of the stratum's certified step rejects the row."""
    stratum, score = stratum_of(stratum_column, strata), scores(m)
    hit = F.lit(False)
    for c in cutoffs:
        for rule, cutoff in c.cutoff.items():
            hit = hit | ((stratum == c.stratum) & (score[rule] > cutoff))
    return hit


def _thin(docs: DataFrame, id_column: str, text_column: str, stratum_column: str) -> DataFrame:
    """``doc_id``, text, stratum, and a mark that equal texts share."""
    text = docs[text_column].cast("string")
    return docs.select(docs[id_column].alias("doc_id"), text.alias("_text"), docs[stratum_column].cast("string").alias("_stratum"),
                       F.xxhash64(text, F.length(text)).alias("_mark"))


def judged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           stratum_column: str = "lang", strata: tuple[str, ...] = STRATA) -> DataFrame:
    """Per row: the id, the measures, ``base_failed``, ``kept``.

    Null, empty and blank texts have no words and fail the base rule. A null or unlisted stratum counts
    as ``other``. Rows with a null id are judged but match no label; rows that share an id are each a document.
    Labels with a null quality or id count for nothing. Without labels only the base rule rejects.
    """
    thin = _thin(docs, id_column, text_column, stratum_column)
    measured = staged(with_measures(thin, "_text").drop("_text"), "measures")
    cutoffs = select_cutoffs(holdout_counts(measured, labels, "doc_id", "_stratum", strata, "_mark"))
    failed = base_failed()
    return measured.select(F.col("doc_id").alias(id_column), "_measures.*", failed.alias("base_failed"),
                           (~failed & ~rejected_by(cutoffs, "_stratum", strata)).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         stratum_column: str = "lang", strata: tuple[str, ...] = STRATA) -> DataFrame:
    """The rows of ``docs`` that :func:`judged` keeps, with their columns, whatever their names.

    Measures are taken twice, first of labelled documents only, so that no text has to be moved or stored.
    """
    ids = staged(labels.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct(), "labelled")
    thin = _thin(docs, id_column, text_column, stratum_column)
    held = with_measures(picked(thin, ids), "_text").drop("_text")
    cutoffs = select_cutoffs(holdout_counts(held, labels, "doc_id", "_stratum", strata, "_mark"))
    name = free_name(docs)
    return with_measures(docs, text_column, name).where(~base_failed(name) & ~rejected_by(cutoffs, stratum_column, strata, name)) \
        .drop(name)
