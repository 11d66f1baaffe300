"""Discovery filters: exclusion rules, the first-match cascade, re-entry, denylists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.text import blank_to_null, contains_any
from hirelake.functions.web import url_domain
from hirelake.operators.keys import first_per, lookup
from hirelake.rules import REFILTER_CLOSED, RUN_TERMINAL, Rules


def company_excluded(name: str, rules: Rules) -> Column:
    return contains_any(name, rules.excluded_companies)


def title_excluded(title: str, rules: Rules) -> Column:
    return contains_any(title, rules.excluded_title_words)


def too_experienced(years: str, rules: Rules) -> Column:
    """Strictly above the cap; unknown and zero never are."""
    return F.coalesce(F.col(years), F.lit(0.0)) > rules.max_experience_years


def keep_companies(companies: DataFrame, rules: Rules) -> DataFrame:
    return companies.where(~company_excluded("name", rules))


def keep_titles(jobs: DataFrame, rules: Rules) -> DataFrame:
    return jobs.where(~title_excluded("title", rules))


def keep_experience(jobs: DataFrame, rules: Rules) -> DataFrame:
    return jobs.where(~too_experienced("experience_years_required", rules))


def normalize_urls(jobs: DataFrame) -> DataFrame:
    """Blank and white-space urls become null, others are trimmed."""
    return jobs.withColumn("url", blank_to_null("url"))


def _verdict(rules: Rules) -> tuple[Column, Column, Column]:
    """Stage, state and note of a job with ``company_name``; the first matching rule decides."""
    by_company, by_title, by_years = (
        company_excluded("company_name", rules), title_excluded("title", rules),
        too_experienced("experience_years_required", rules))
    stage = F.when(by_company | by_title | by_years, 2).otherwise(3)
    state = F.when(by_company, "Excluded Company").when(by_title | by_years, "Ghost Job") \
        .otherwise("Company Research")
    note = (
        F.when(by_company, F.concat(F.lit("excluded company: "), "company_name"))
        .when(by_title, F.concat(F.lit("excluded word in title: "), "title"))
        .when(by_years, F.concat(
            F.lit("needs "), F.col("experience_years_required").cast("string"),
            F.lit(f" years, limit {rules.max_experience_years}")))
        .otherwise("passed screening"))
    return stage, state, note


def screen(jobs: DataFrame, companies: DataFrame, rules: Rules) -> DataFrame:
    """First matching rule per job decides: company, title, experience, pass.

    Adds ``current_stage``, ``state`` and ``note`` to ``(job_id, company_id)``.
    """
    joined = jobs.join(
        companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")),
        "company_id")
    stage, state, note = _verdict(rules)
    return joined.select(F.col("id").alias("job_id"), "company_id", stage.alias("current_stage"),
                         state.alias("state"), note.alias("note"))


def enter_screening(
    jobs: DataFrame, companies: DataFrame, applications: DataFrame, rules: Rules
) -> DataFrame:
    """Applications after screening a list of jobs, with ``state`` and ``note``.

    A job with an application returns that one unless it is closed, without a note; a job without gets
    a new row, also if it is rejected (:func:`admitted` leaves those out). ``application_id`` is null
    for new rows. New rows of jobs without a company are left out.
    """
    stored = first_per(
        applications.select("job_id", "id", "current_stage", "state"), ["job_id"], "id") \
        .select(F.col("job_id").alias("_job"), F.col("id").alias("application_id"),
                F.col("current_stage").alias("_stage"), F.col("state").alias("_state"))
    names = companies.select(F.col("id").alias("_company"), F.col("name").alias("company_name"), F.lit(True).alias("_named"))
    known = lookup(jobs, stored, ["id"], ["_job"])
    known = lookup(known, names, ["company_id"], ["_company"], row_id="id")
    is_new = F.col("application_id").isNull()
    stage, state, note = _verdict(rules)
    goes_in = F.when(is_new, F.col("_named")).otherwise(~F.col("_state").isin(*REFILTER_CLOSED))
    return known.where(goes_in).select(
        F.col("id").alias("job_id"), "application_id",
        F.when(is_new, stage).otherwise(F.col("_stage")).cast("int").alias("current_stage"),
        F.when(is_new, state).otherwise(F.col("_state")).alias("state"),
        is_new.alias("is_new"), F.when(is_new, note).alias("note"))


def admitted(entered: DataFrame) -> DataFrame:
    """Rows of :func:`enter_screening` that go on."""
    return entered.where(~F.col("is_new") | (F.col("current_stage") != 2))


def unfinished(applications: DataFrame) -> DataFrame:
    """Applications a resumed run picks up."""
    return applications.where(~F.col("state").isin(*RUN_TERMINAL))


def resume_or_discover(applications: DataFrame, discovered: DataFrame) -> DataFrame:
    """Unfinished applications if there are any, else the discovered ones.

    The only driver-side branch of the library: one ``isEmpty`` probe (a limit-1 job).
    """
    waiting = unfinished(applications)
    return discovered if waiting.isEmpty() else waiting


def drop_denied(pages: DataFrame, denied: DataFrame, block_heavy: Sequence[str]) -> DataFrame:
    """Pages whose domain is not on the list, exact match; flags block-heavy hosts, substring match."""
    with_domain = pages.withColumn("domain", url_domain("url"))
    kept = lookup(with_domain, denied.select("domain").distinct(), ["domain"], ["domain"], how="left_anti")
    return kept.withColumn("is_block_heavy", contains_any("domain", block_heavy))


def carve_out(companies: DataFrame, exclusions: Sequence[str]) -> DataFrame:
    """Per target company, the exclusions that do not name it (``kept`` array)."""
    terms = F.array(*[F.lit(t) for t in exclusions]).cast("array<string>")
    return companies.withColumn(
        "kept", F.filter(terms, lambda t: ~F.contains(F.lower("name"), F.lower(t))))
