"""Outcomes of the steps from what is stored: cached values first, answers of a model for the misses, fallbacks.

The frames made here are inputs of :class:`hirelake.plans.advance.Snapshot`; nothing is computed before its plan runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import slug
from hirelake.operators import cache
from hirelake.operators.responses import parse
from hirelake.rules import Rules
from hirelake.sources.schemas import RESPONSES


def research_key(name: Column | str) -> Column:
    return F.concat(F.lit("company_research_"), F.lower(name))


def mailbox_key(company: Column | str, contact: Column | str) -> Column:
    return F.concat(F.lit("email_"), F.lower(company), F.lit("_"), slug(contact))


def research(companies: DataFrame, entries: DataFrame, answers: DataFrame, as_of: str) -> DataFrame:
    """``(company_id, research_ok, origin)``: live cache entries count as they are, else an answer of the right form.

    ``answers(company_id, raw)`` are asked for the misses only, so those alone are parsed.
    """
    asked = companies.select(F.col("id").alias("company_id"), research_key("name").alias("key"))
    looked = cache.lookup(asked, entries, as_of)
    answered = looked.join(answers.select("company_id", "raw"), "company_id", "left")
    parsed = parse(answered.withColumn("raw", F.when(~F.col("hit"), F.col("raw"))), "raw", RESPONSES["company_research"])
    origin = F.when(F.col("hit"), "cache").when(F.col("accepted"), "answer").otherwise("none")
    return parsed.select("company_id", (F.col("hit") | F.col("accepted")).alias("research_ok"), origin.alias("origin"))


def research_to_store(found: DataFrame, companies: DataFrame, answers: DataFrame, as_of: str) -> DataFrame:
    """Writes for :func:`hirelake.operators.cache.write`: the accepted answers, for the rules' lifetime."""
    new = found.where(F.col("origin") == "answer").select("company_id")
    rows = answers.join(new, "company_id", "left_semi").join(
        companies.select(F.col("id").alias("company_id"), research_key("name").alias("key")), "company_id")
    return rows.select("key", F.col("company_id").alias("version"), F.col("raw").alias("value"),
                       F.lit(as_of).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("bigint").alias("ttl_seconds"))


def mailboxes(contacts: DataFrame, companies: DataFrame, entries: DataFrame, answers: DataFrame, as_of: str) -> DataFrame:
    """``(contact_id, answer)``: the address found for a contact, cached or answered; contacts without one are left out."""
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    asked = contacts.select(F.col("id").alias("contact_id"), "company_id", "name").join(names, "company_id").select(
        "contact_id", mailbox_key("company", "name").alias("key"))
    looked = cache.lookup(asked, entries, as_of)
    answered = looked.join(answers.select("contact_id", "raw"), "contact_id", "left")
    parsed = parse(answered.withColumn("raw", F.when(~F.col("hit"), F.col("raw"))), "raw", RESPONSES["email_discovery"])
    answer = F.coalesce(F.when(F.col("hit"), F.col("value")), "response.email")
    # An outer explode keeps the filter behind the parsing.
    found = parsed.select("contact_id", F.explode(F.array_compact(F.array(F.nullif(answer, F.lit(""))))).alias("answer"))
    return found


def with_outcomes(rows: DataFrame) -> DataFrame:
    """Replaces the raw answers of applications by their outcomes.

    ``score_raw, tailor_raw, message_raw, validation_raw`` become the score's components (null, which fails its gate, unless
    the answer is of the right form), ``tailor_ok``, ``keywords``, ``reasoning``, ``subject``, ``body_html``, ``valid_ok``. Tailoring
    falls back to the base resume and a message to the plain one, so neither fails; a validation that cannot be
    read passes. Only rows that a run judges get here, so nothing else is parsed.
    """
    for name, schema in (("score", "opportunity_score"), ("tailor", "resume_tailor"), ("message", "email_message"),
                         ("validation", "validation")):
        rows = parse(rows, f"{name}_raw", RESPONSES[schema]).withColumnRenamed("response", f"_{name}").drop("accepted", f"{name}_raw")
    made = {c: F.col(f"_score.{c}") for c in Rules.COMPONENTS} | {
        "tailor_ok": F.lit(True), "keywords": F.coalesce("_tailor.keywords_added", F.array().cast("array<string>")),
        "reasoning": F.coalesce("_tailor.reasoning", F.lit("base resume kept")),
        "subject": F.col("_message.subject"), "body_html": F.col("_message.body_html"),
        "valid_ok": F.coalesce("_validation.is_valid", F.lit(True))}
    return rows.withColumns(made).drop("_score", "_tailor", "_message", "_validation")
