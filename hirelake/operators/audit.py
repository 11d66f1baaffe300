"""Integrity audit: key, uniqueness and reference constraints as counts of violations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

# Constraints of the entity tables.
UNIQUE = (
    ("runs", "id"), ("companies", "id"), ("companies", "name"), ("jobs", "id"), ("jobs", "url"),
    ("contacts", "id"), ("contacts", "email"), ("applications", "id"), ("emails", "id"),
    ("resume_versions", "id"), ("history", "id"), ("cache_entries", "key"),
)
REFERENCES = (
    ("jobs", "company_id", "companies"), ("contacts", "company_id", "companies"),
    ("applications", "run_id", "runs"), ("applications", "job_id", "jobs"),
    ("applications", "contact_id", "contacts"), ("emails", "application_id", "applications"),
    ("resume_versions", "application_id", "applications"),
    ("history", "application_id", "applications"), ("history", "run_id", "runs"),
)


# Spaces of values that have to be keys of a parent, by table.
ID = "id"


def _whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, IntegralType)


def _entries(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str, int]]:
    """``(table, column, space, slot)`` of everything an audit looks at; slot 0 is a key, others are references to it."""
    parents = dict.fromkeys(p for t, _, p in REFERENCES if t in tables and p in tables)
    made = [(t, c, f"{t}.{c}", 0) for t, c in UNIQUE if t in tables]
    made += [(p, ID, f"{p}.{ID}", 0) for p in parents if (p, ID) not in UNIQUE]
    slots = Counter()
    for t, c, p in REFERENCES:
        if t in tables and p in tables:
            slots[p] += 1
            made.append((t, c, f"{p}.{ID}", slots[p]))
    return made


def _pairs(name: str, tables: Mapping[str, DataFrame], entries: list[tuple[str, str, str, int]]) -> DataFrame:
    """``(space, number, value, slot)`` of one table's rows, from one pass over it.

    A space is a column whose values are keys, given by its number; ``slot`` is 0 for a key and else tells the reference that
    uses it. Values are numbers where all columns of a space are whole numbers, else texts.
    """
    spaces = list(dict.fromkeys(space for _, _, space, _ in entries))
    whole = {s: all(_whole(tables[t], c) for t, c, space, _ in entries if space == s) for s in spaces}
    number, value = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    made = F.array(*[F.struct(F.lit(spaces.index(s)).alias("space"), (F.col(c).cast("bigint") if whole[s] else number).alias("number"),
                              (value if whole[s] else F.col(c).cast("string")).alias("value"), F.lit(slot).alias("slot"))
                     for t, c, s, slot in entries if t == name])
    return tables[name].select(F.explode(made).alias("e")).select("e.*").where(F.col("number").isNotNull() | F.col("value").isNotNull())


def integrity(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(constraint_name, violations)`` for every constraint whose tables are given.

    Uniqueness counts the values held by more than one row, a reference the rows whose non-null value has no parent. Every
    table is read once; one aggregate by value, combined before its shuffle, serves all constraints, so a
    popular parent is a few rows in it and nothing is joined. A task holds a row for each of its values, so rows are narrow:
    numbers stay numbers, and there are only as many counts as one parent has references.
    """
    entries = _entries(tables)
    spaces = list(dict.fromkeys(space for _, _, space, _ in entries))
    used = [name for name in tables if any(t == name for t, _, _, _ in entries)]
    pairs = reduce(DataFrame.unionByName, [_pairs(name, tables, entries) for name in used])
    values = pairs.groupBy("space", "number", "value").agg(
        *[F.count_if(F.col("slot") == i).alias(f"n{i}") for i in range(1 + max(slot for _, _, _, slot in entries))])

    def of(space: str) -> Column:
        return F.col("space") == spaces.index(space)

    checks = {f"unique {t}.{c}": F.count_if(of(f"{t}.{c}") & (F.col("n0") > 1)) for t, c in UNIQUE if t in tables}
    checks |= {f"reference {t}.{c}": F.coalesce(F.sum(F.when(of(space) & (F.col("n0") == 0), F.col(f"n{slot}"))), F.lit(0))
               for t, c, space, slot in entries if slot}
    found = values.agg(*[violations.alias(f"c{i}") for i, violations in enumerate(checks.values())])
    listed = F.array(*[F.struct(F.lit(name).alias("constraint_name"), F.col(f"c{i}").cast("bigint").alias("violations"))
                       for i, name in enumerate(checks)])
    return found.select(F.explode(listed).alias("c")).select("c.*")
