"""Structured generation: prompts as a column, a provider on the executors, typed rows out."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.operators.cache import is_live
from hirelake.operators.keys import lookup
from hirelake.operators.responses import parse
from hirelake.session import staged

# Tasks get this module's functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Provider(Protocol):
    """Answers a batch of prompts. Instances are shipped to the tasks."""

    def generate(self, prompts: list[str], instruction: str) -> list[str]: ...


class OfflineProvider:
    """Deterministic stand-in for a model service: fills each integer field with the prompt size,
    other scalars with fixed values. Prompts without any letter get an unusable answer."""

    def __init__(self, schema: T.StructType):
        self.fields = [(f.name, type(f.dataType).__name__) for f in schema.fields]

    def generate(self, prompts: list[str], instruction: str) -> list[str]:
        return [self._answer(p) for p in prompts]

    def _answer(self, prompt: str) -> str:
        if not any(ch.isalpha() for ch in prompt):
            return "no answer"
        fill = {"IntegerType": len(prompt), "DoubleType": 0.5, "BooleanType": True, "ArrayType": []}
        body = json.dumps({name: fill.get(kind, "text") for name, kind in self.fields})
        return f"```json\n{body}\n```"


def instruction_for(schema: T.StructType) -> str:
    """Names the fields and types the answer must have."""
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema.fields)
    return f"Answer with one JSON object holding {fields}."


def answers(prompts: DataFrame, prompt: str, schema: T.StructType, provider: Provider) -> DataFrame:
    """``(prompt, raw)`` for each distinct prompt, one provider call per Arrow batch."""
    instruction = instruction_for(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[prompt].tolist()
            yield pd.DataFrame({prompt: asked, "raw": provider.generate(asked, instruction)})

    return prompts.select(prompt).distinct().mapInPandas(run, f"{prompt} STRING, raw STRING")


def structured_generate(df: DataFrame, prompt: str, schema: T.StructType, provider: Provider,
                        cached: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Add the typed ``response`` and ``accepted`` to every row.

    Equal prompts are asked once; live cache entries ``(key, value, expires_at)`` are not asked at
    all. Answers are written to the shared folder before they are parsed, so reading accepted and
    rejected rows never calls the provider again. A row with a null prompt is not asked and not accepted.
    """
    asked = df.where(F.col(prompt).isNotNull()).select(prompt).distinct()
    if cached is not None:
        live = cached.where(is_live(as_of)).groupBy(F.col("key").alias(prompt)) \
            .agg(F.max_by("value", "expires_at").alias("raw"))
        hits = asked.join(live, prompt)
        misses = asked.join(live, prompt, "left_anti")
        raw = staged(answers(misses, prompt, schema, provider), "answers").unionByName(hits)
    else:
        raw = staged(answers(asked, prompt, schema, provider), "answers")
    parsed = parse(raw, "raw", schema).select(F.col(prompt).alias("_asked"), "accepted", "response")
    whole = F.struct(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    found = lookup(df.withColumn("_row", whole), parsed, [prompt], ["_asked"], row_id="_row").drop("_row")
    return found.withColumn("accepted", F.coalesce("accepted", F.lit(False)))
