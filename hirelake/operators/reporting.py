"""Status and list reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.display import (
    age_text,
    base_name,
    score_or_null,
    score_shown,
    stage_label,
    stage_percent,
)
from hirelake.functions.text import or_text
from hirelake.operators.keys import last_per, lookup
from hirelake.rules import CLI_FILTERED, RETRYABLE, WEB_FILTERED, WEB_TERMINAL, Rules

LIST_LIMIT = 200
RECENT_LIMIT = 10


def with_job_and_company(applications: DataFrame, jobs: DataFrame, companies: DataFrame,
                         job_columns: dict[str, str] | None = None,
                         company_columns: dict[str, str] | None = None) -> DataFrame:
    """application, job and company, inner; only the named parent columns are read."""
    job_columns = {"title": "job_title", **(job_columns or {})}
    company_columns = {"name": "company_name", **(company_columns or {})}
    j = jobs.select(F.col("id").alias("job_id"), "company_id",
                    *[F.col(k).alias(v) for k, v in job_columns.items()])
    c = companies.select(F.col("id").alias("company_id"),
                         *[F.col(k).alias(v) for k, v in company_columns.items()])
    return applications.join(j, "job_id").join(c, "company_id")


def with_contact(rows: DataFrame, contacts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Left join of the contact; rows without one are spread instead of meeting in one task."""
    c = contacts.select(F.col("id").alias("_cid"), *[F.col(k).alias(v) for k, v in columns.items()])
    return lookup(rows, c, ["contact_id"], ["_cid"], "id")


def active_list(applications: DataFrame, jobs: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """Applications in progress with stage label, percent, age text and score."""
    live = applications.where(~F.col("state").isin(*WEB_TERMINAL))
    rows = with_job_and_company(live, jobs, companies)
    return rows.select(
        "id", "run_id", "company_name", "job_title", "current_stage",
        stage_label("current_stage", "state").alias("stage_name"),
        stage_percent("current_stage").alias("stage_percent"), "state",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
        age_text("updated_at", as_of).alias("updated_ago"),
        score_or_null("score").alias("score"),
    ).orderBy(F.desc("updated_at"), "id")


def full_list(applications: DataFrame, jobs: DataFrame, companies: DataFrame,
              contacts: DataFrame) -> DataFrame:
    """All applications, newest first."""
    rows = with_contact(with_job_and_company(applications, jobs, companies), contacts,
                        {"email": "contact_email"})
    return rows.select(
        "id", "run_id", "company_name", "job_title", "current_stage",
        stage_label("current_stage", "state").alias("stage_name"), "state",
        score_shown("score").alias("score"),
        or_text("contact_email", "N/A").alias("contact_email"),
        or_text("tailored_resume_path", "N/A").alias("resume_path"),
        or_text(base_name("tailored_resume_path"), "N/A").alias("resume_file"),
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
    ).orderBy(F.desc("updated_at"), "id")


def company_list(companies: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    count = F.when(F.col("employee_count") == 0, None).otherwise(F.col("employee_count"))
    return companies.orderBy("name", "id").limit(limit).select(
        "id", "name", or_text("domain", "N/A").alias("domain"),
        F.coalesce(count.cast("string"), F.lit("N/A")).alias("employee_count"),
        or_text("industry", "N/A").alias("industry"))


def contact_list(contacts: DataFrame, companies: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return contacts.join(c, "company_id").orderBy(F.desc("id")).limit(limit).select(
        "id", "company_name", "name", "role", or_text("email", "N/A").alias("email"))


def job_list(jobs: DataFrame, companies: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return jobs.join(c, "company_id").orderBy(F.desc("id")).limit(limit).select(
        "id", "company_name", "title", or_text("url", "N/A").alias("url"))


def recent(applications: DataFrame, jobs: DataFrame, companies: DataFrame,
           limit: int = RECENT_LIMIT) -> DataFrame:
    """The most recently updated applications; the limit runs before the joins."""
    newest = applications.orderBy(F.desc("updated_at"), "id").limit(limit)
    return with_job_and_company(newest, jobs, companies).select(
        "id", "company_name", "job_title", F.concat(F.lit("Stage "), "current_stage").alias("stage"),
        "state", F.when(F.col("score") != 0, F.printf(F.lit("%.2f"), "score")).otherwise("N/A").alias("score"))


def drafted_applications(emails: DataFrame) -> DataFrame:
    """Ids of the applications that have a message with a draft id."""
    return emails.where(F.col("gmail_draft_id").isNotNull()).select(
        F.col("application_id").alias("id")).distinct()


def completed_applications(applications: DataFrame, emails: DataFrame) -> DataFrame:
    """Completed by state, or by having a draft."""
    drafted = drafted_applications(emails).withColumn("_drafted", F.lit(True))
    return applications.join(drafted, "id", "left").where(
        (F.col("state") == "Completed") | F.col("_drafted")).drop("_drafted")


def web_summary(applications: DataFrame, jobs: DataFrame, companies: DataFrame,
                emails: DataFrame) -> DataFrame:
    """Total, completed, failed, filtered and active in one aggregate; the groups overlap."""
    drafted = drafted_applications(emails).withColumn("_drafted", F.lit(True))
    placed = jobs.select(F.col("id").alias("job_id"), "company_id").join(
        companies.select(F.col("id").alias("company_id")), "company_id"
    ).select("job_id", F.lit(True).alias("_placed"))
    rows = applications.select("id", "job_id", "state").join(drafted, "id", "left") \
        .join(placed, "job_id", "left")
    state = F.col("state")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if((state == "Completed") | F.col("_drafted")).alias("completed"),
        F.count_if(state.ilike("%failed%") | state.ilike("%error%")).alias("failed"),
        F.count_if(state.isin(*WEB_FILTERED)).alias("filtered"),
        F.count_if(~state.isin(*WEB_TERMINAL) & F.col("_placed")).alias("active"))


def cli_summary(applications: DataFrame) -> DataFrame:
    state = F.col("state")
    return applications.agg(
        F.count("*").alias("total"), F.count_if(state == "Completed").alias("completed"),
        F.count_if(state.isin(*RETRYABLE)).alias("failed"),
        F.count_if(state.isin(*CLI_FILTERED)).alias("filtered"))


def running_runs(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if(F.col("status") == "running").alias("active_runs"))


def drafts_on_day(emails: DataFrame, as_of: str) -> DataFrame:
    """Drafts made on the day of ``as_of``, a half-open interval that reaches the scan."""
    start = F.date_trunc("day", F.lit(as_of).cast("timestamp")).cast("timestamp_ntz")
    on_day = (F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL 1 DAY"))
    return emails.where((F.col("status") == "draft_created") & on_day) \
        .agg(F.count("*").alias("drafts_today"))


def next_run_ids(runs: DataFrame) -> DataFrame:
    """Next free run id per day prefix: greatest numeric suffix plus one, at least three digits.

    A suffix that is no number counts as none, so such a prefix restarts at 001.
    """
    prefix = F.regexp_extract("id", r"^(RUN-\d{8}-)", 1)
    suffix = F.element_at(F.split("id", "-"), -1).try_cast("bigint")
    top = runs.where(prefix != "").groupBy(prefix.alias("prefix")).agg(F.max(suffix).alias("_top"))
    return top.select("prefix", F.concat(
        "prefix", F.printf(F.lit("%03d"), F.coalesce(F.col("_top"), F.lit(0)) + 1)).alias("next_id"))


def stage_funnel(applications: DataFrame) -> DataFrame:
    """Applications per stage and state with subtotals per stage and a grand total."""
    return applications.rollup("current_stage", "state").agg(F.count("*").alias("applications"))


def latest_per_application(rows: DataFrame) -> DataFrame:
    """Row with the greatest id per application (messages, resume versions)."""
    return last_per(rows, ["application_id"], "id")


def timeline(history: DataFrame) -> DataFrame:
    """Transitions of every application, newest first.

    A range-partitioned sort on (application, time, id): an application with very many
    transitions spreads over several partitions.
    """
    return history.select("application_id", "stage", "state", "timestamp", "notes", "id") \
        .orderBy("application_id", F.desc("timestamp"), F.desc("id"))


def details(applications: DataFrame, jobs: DataFrame, companies: DataFrame, contacts: DataFrame,
            emails: DataFrame, resumes: DataFrame, history: DataFrame) -> DataFrame:
    """One inspection row per application: parents, latest message, latest resume, history size.

    The history itself is :func:`timeline`; it stays a table, since nesting it would gather all
    rows of an application into one value.
    """
    mail = latest_per_application(emails.select(
        "id", "application_id", "subject", "gmail_draft_id", "status")).select(
        F.col("application_id").alias("id"), F.col("subject").alias("email_subject"),
        F.col("gmail_draft_id").alias("email_draft_id"), F.col("status").alias("email_status"))
    resume = latest_per_application(resumes.select("id", "application_id", "parent_resume", "path")) \
        .select(F.col("application_id").alias("id"), "parent_resume", F.col("path").alias("resume_path"))
    events = history.groupBy(F.col("application_id").alias("id")).agg(
        F.count("*").alias("history_rows"), F.max_by("state", F.struct("timestamp", "id")).alias("last_event"))
    rows = applications.join(mail, "id", "left").join(resume, "id", "left").join(events, "id", "left")
    rows = with_job_and_company(rows, jobs, companies, company_columns={
        "domain": "company_domain", "industry": "company_industry"})
    rows = with_contact(rows, contacts, {
        "name": "contact_name", "role": "contact_role", "email": "contact_email"})
    return rows.select(
        "id", "run_id", "current_stage", stage_label("current_stage", "state").alias("stage_name"),
        "state", score_shown("score").alias("score"), "tailored_resume_path", "job_title",
        "company_name", or_text("company_domain", "N/A").alias("company_domain"),
        or_text("company_industry", "N/A").alias("company_industry"),
        or_text("contact_name", "N/A").alias("contact_name"),
        or_text("contact_role", "N/A").alias("contact_role"),
        or_text("contact_email", "N/A").alias("contact_email"),
        "email_subject", "email_draft_id", "email_status", "parent_resume", "resume_path",
        F.coalesce("history_rows", F.lit(0)).alias("history_rows"), "last_event")


def application_details(application_id: int, applications: DataFrame, *tables: DataFrame) -> DataFrame:
    """:func:`details` of one application; the filter reaches the scans of its own rows."""
    jobs, companies, contacts, emails, resumes, history = tables
    own = F.col("application_id") == application_id
    return details(applications.where(F.col("id") == application_id), jobs, companies, contacts,
                   emails.where(own), resumes.where(own), history.where(own))


def weighted_scores(scores: DataFrame, rules: Rules) -> DataFrame:
    """Weighted sum in the fixed component order, and whether it reaches the threshold."""
    total = None
    for c in rules.COMPONENTS:
        term = F.col(c) * F.lit(rules.weights[c])
        total = term if total is None else total + term
    return scores.withColumn("score", total).withColumn(
        "passes", ~(F.col("score") < rules.minimum_score))
