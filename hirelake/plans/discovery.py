"""A discovery run: found companies and job responses to stored rows and entered applications."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators.filtering import enter_screening
from hirelake.operators.keys import lookup
from hirelake.operators.resolution import speculative_jobs, upsert_companies, upsert_jobs
from hirelake.operators.responses import explode_rows, parse
from hirelake.rules import Rules
from hirelake.session import staged
from hirelake.sources.schemas import RESPONSES

JOB_COLUMNS = ("company_id", "title", "url", "location", "experience_years_required")


@dataclass(frozen=True)
class Discovered:
    """``companies`` and ``jobs`` of the run (``is_new`` marks created ones); ``entered`` goes on."""

    companies: DataFrame
    jobs: DataFrame
    entered: DataFrame


def response_jobs(responses: DataFrame) -> DataFrame:
    """Jobs of the accepted responses ``(company_id, raw)``, with their position."""
    parsed = parse(responses, "raw", RESPONSES["job_list"])
    return explode_rows(parsed, "jobs", ["company_id"]).withColumnRenamed(
        "experience_years", "experience_years_required")


def discover(companies: DataFrame, jobs: DataFrame, applications: DataFrame, found: DataFrame,
             responses: DataFrame, rules: Rules) -> Discovered:
    """Get or create the found companies and their jobs, then screen the jobs.

    ``found(ordinal, name, ...)`` lists companies in discovery order, ``responses(company_id, raw)``
    the job answers. A company without usable jobs gets a speculative one if the rules allow it. Jobs
    count in company order, then in list order. Companies, parsed jobs and resolved jobs are written to
    the shared folder, because later steps read them several times.
    """
    known = staged(upsert_companies(companies, found), "companies")
    order = known.select("id", "ordinal")
    listed = staged(lookup(response_jobs(responses), order, ["company_id"], ["id"], how="inner"), "listed")
    invented = lookup(speculative_jobs(known, listed, rules), order, ["company_id"], ["id"], how="inner")
    rows = listed.select(*JOB_COLUMNS, "ordinal", "pos").unionByName(
        invented.select(*JOB_COLUMNS, "ordinal", F.lit(0).alias("pos")))
    resolved = upsert_jobs(jobs, rows, minor="pos")
    full = resolved.where("is_new").select("id", *JOB_COLUMNS, "is_new")
    stored = jobs.join(resolved.where(~F.col("is_new")).select("id"), "id", "left_semi")
    stored = stored.select("id", *[F.col(c) if c in jobs.columns else F.lit(None).cast("string").alias(c)
                                   for c in JOB_COLUMNS], F.lit(False).alias("is_new"))
    all_jobs = staged(full.unionByName(stored), "jobs")
    names = companies.select("id", "name").unionByName(known.where("is_new").select("id", "name"))
    entered = enter_screening(all_jobs.drop("is_new"), names, applications, rules)
    return Discovered(known, all_jobs, entered)
