"""Everything a run leaves behind: applications, contacts, messages, resume versions, history, under one commit.

All tables start from one judgement (:func:`hirelake.plans.advance.verdicts`) and have the columns of the tables the run
started from, so the next run starts from them.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.text import slug
from hirelake.operators.keys import dense_ids
from hirelake.operators.messages import render, sign
from hirelake.plans import advance as steps
from hirelake.plans.advance import Snapshot, created_contacts, gates, judged, with_contacts
from hirelake.rules import DONE_STAGE, STATE_ON_ENTRY, Rules
from hirelake.session import staged

# Where a tailored resume goes, and the one it was made from.
RESUME_DIR, BASE_RESUME = "out", "base.typ"
# The message of an application for which none was written.
PLAIN_SUBJECT = "Application to {company}"
PLAIN_BODY = "<p>Hello {contact},</p><p>I would like to join {company} as {role}.</p><p>{sender}</p>"


@dataclass(frozen=True)
class RunTables:
    """The tables after a run; ``history`` holds the run's own rows."""

    applications: DataFrame
    contacts: DataFrame
    emails: DataFrame
    resumes: DataFrame
    history: DataFrame


def _given(rows: DataFrame, column: str, kind: str = "string") -> Column:
    """A column that the outcomes may lack."""
    return F.col(column).cast(kind) if column in rows.columns else F.lit(None).cast(kind)


def _resume_path() -> Column:
    return F.concat(F.lit(f"{RESUME_DIR}/resume_"), slug("company_name"), F.lit("_"), slug("job_title"), F.lit("_"),
                    F.col("id").cast("string"), F.lit(f"/{BASE_RESUME}"))


def _draft_id(rows: DataFrame) -> Column:
    return F.coalesce(_given(rows, "draft_id"), F.concat(F.lit("draft-"), F.col("id").cast("string")))


def history_rows(rows: DataFrame, max_stage: int = DONE_STAGE) -> DataFrame:
    """One row per logged transition of :func:`with_contacts` rows: ``(application_id, step, stage, state, note)``.

    A stage that only finds its work done logs nothing: a contact linked before, a mailbox known, also to a row before
    in the same run.
    """
    found_before = steps._resolved() & F.col("owner").isNull() & (F.col("setter.own_contact") == F.col("own_contact")) \
        & (F.col("setter.id") < F.col("id"))
    passed = {
        3: F.lit("company researched"),
        4: F.concat(F.lit("contact: "), F.coalesce("contact.name", F.lit(""))),
        5: F.concat(F.lit("mailbox: "), F.coalesce("mailbox", F.lit(""))),
        6: F.lit("scored high enough"), 7: F.concat(F.lit("resume: "), _resume_path()), 8: F.lit("message written"),
        9: F.lit("validated"), 10: F.concat(F.lit("draft: "), _draft_id(rows)), 11: F.lit("all stages done"),
    }
    failed = {
        3: F.lit("nothing found on the company"), 4: F.lit("company or mailbox already written to"),
        5: F.when(F.col("contact").isNull(), "no contact").otherwise(F.concat(F.lit("no mailbox for "), "contact.name")),
        6: F.when(F.col("passes").isNull(), "no score").otherwise("score below the threshold"),
        7: F.lit("resume not tailored"), 8: F.lit("no contact"), 9: F.lit("message rejected"), 10: F.lit("no draft made"),
        11: F.lit("not finalized"),
    }
    entries = []
    for stage in gates():
        if stage > max_stage:
            break
        silent = F.array_contains("quiet", stage)
        if stage == 5:
            silent = silent | F.coalesce(found_before, F.lit(False))
        entries.append(F.when(steps._ran(stage) & ~silent, F.struct(
            F.lit(stage + 1).alias("stage"), F.lit(STATE_ON_ENTRY[stage + 1]).alias("state"), passed[stage].alias("note"))))
        entries.append(F.when((F.col("stop") == stage) & F.col("stop_logged"), F.struct(
            F.lit(stage).alias("stage"), F.col("end_state").alias("state"), failed[stage].alias("note"))))
    made = F.array_compact(F.array(*entries))
    return rows.select("id", F.posexplode(made).alias("step", "e")).select(
        F.col("id").alias("application_id"), "step", "e.stage", "e.state", "e.note")


def history_of(s: Snapshot, rules: Rules, run_id: str, as_of: str, max_stage: int = DONE_STAGE) -> DataFrame:
    """History rows a run writes: one per logged transition, in order, with run, time and note."""
    rows = with_contacts(judged(s, rules, max_stage), s.contacts)
    return _dated(history_rows(rows, max_stage), run_id, as_of)


def _dated(history: DataFrame, run_id: str, as_of: str) -> DataFrame:
    return history.select("application_id", "step", "stage", "state", F.lit(run_id).alias("run_id"),
                          F.lit(as_of).cast("timestamp_ntz").alias("timestamp"), F.col("note").alias("notes"))


def applications_after(s: Snapshot, rows: DataFrame, as_of: str) -> DataFrame:
    """All applications; those the run changed with its stage, state, contact, score, resume and time."""
    moved = steps._moved_rows(rows).select(
        "id", F.struct("current_stage", "state", "contact_id", "score").alias("_new"))
    resume = rows.where(steps._ran(7)).select("id", _resume_path().alias("_resume"))
    joined = s.applications.join(moved, "id", "left").join(resume, "id", "left")
    changed = F.col("_new").isNotNull() & ((F.col("_new.current_stage") != F.col("current_stage")) | (F.col("_new.state") != F.col("state")))
    updates = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).cast(s.applications.schema[c].dataType)
               for c in ("contact_id", "score")}
    updates |= {"updated_at": F.when(changed, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at")),
                "tailored_resume_path": F.coalesce("_resume", "tailored_resume_path"),
                "current_stage": F.coalesce("_new.current_stage", "current_stage").cast("int"),
                "state": F.coalesce("_new.state", "state")}
    return joined.select(*[updates.get(c, F.col(c)).alias(c) for c in s.applications.columns])


def contacts_after(s: Snapshot, rows: DataFrame) -> DataFrame:
    """All contacts: mailboxes found in the run set, stand-ins made; ``origin`` is stored, found or made."""
    found = rows.where(steps._resolved() & F.col("owner").isNull() & (F.col("setter.own_contact") == F.col("own_contact"))) \
        .groupBy(F.col("own_contact").alias("id")).agg(F.min_by("guess", "id").alias("_found"))
    stored = s.contacts.join(found, "id", "left").withColumn("email", F.coalesce("_found", "email")) \
        .withColumn("origin", F.when(F.col("_found").isNotNull(), "found").otherwise("stored")).drop("_found")
    made = created_contacts(rows, s.contacts).join(found, "id", "left") \
        .withColumnRenamed("_found", "email").withColumn("origin", F.lit("made"))
    columns = [c for c in made.columns if c in stored.columns]
    return stored.unionByName(made.select(*columns), allowMissingColumns=True)


def emails_after(s: Snapshot, rows: DataFrame, rules: Rules, as_of: str) -> DataFrame:
    """All messages: one more for each application that passed their writing; drafts noted on the latest one."""
    drafted = F.when(steps._ran(10), _draft_id(rows))
    names = {"company": F.col("company_name"), "role": F.col("job_title"), "contact": F.coalesce("contact.name", F.lit("")),
             "sender": F.lit(rules.sender_name)}
    written = rows.where(steps._ran(8)).select(
        F.col("id").alias("application_id"), F.coalesce(_given(rows, "subject"), render(PLAIN_SUBJECT, names)).alias("subject"),
        sign(F.coalesce(_given(rows, "body_html"), render(PLAIN_BODY, names)), rules).alias("body"), drafted.alias("gmail_draft_id"))
    new = dense_ids(staged(written, "written"), "application_id", "id", s.emails.agg(F.max("id"))).select(
        "id", "application_id", "subject", "body", "gmail_draft_id",
        F.when(F.col("gmail_draft_id").isNotNull(), "draft_created").otherwise("generated").alias("status"),
        F.lit(as_of).cast("timestamp_ntz").alias("created_at"), F.lit("written").alias("origin"))
    late = rows.where(steps._ran(10) & (F.col("start") > 8)).select(F.col("mail.id").alias("id"), drafted.alias("_draft"))
    stored = s.emails.join(late, "id", "left")
    has = F.col("_draft").isNotNull()
    stored = stored.withColumn("gmail_draft_id", F.coalesce("_draft", "gmail_draft_id")) \
        .withColumn("status", F.when(has, "draft_created").otherwise(F.col("status"))) \
        .withColumn("origin", F.when(has, "drafted").otherwise("stored")).drop("_draft")
    return stored.unionByName(new)


def resumes_after(s: Snapshot, rows: DataFrame, as_of: str) -> DataFrame:
    """All resume versions: one more for each application that passed the tailoring."""
    tailored = rows.where(steps._ran(7)).select(
        F.col("id").alias("application_id"), F.lit(BASE_RESUME).alias("parent_resume"), _resume_path().alias("path"),
        F.col("company_name").alias("company"), F.col("job_title").alias("role"),
        F.coalesce(_given(rows, "keywords", "array<string>"), F.array().cast("array<string>")).alias("keywords_added"),
        _given(rows, "reasoning").alias("reasoning"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"))
    new = dense_ids(staged(tailored, "tailored"), "application_id", "id", s.resumes.agg(F.max("id")))
    return s.resumes.withColumn("origin", F.lit("stored")).unionByName(
        new.withColumn("origin", F.lit("tailored")), allowMissingColumns=True)


def run_tables(s: Snapshot, rules: Rules, run_id: str, as_of: str, max_stage: int = DONE_STAGE,
               daily_limit: int | None = None) -> RunTables:
    """The tables after one run over all applications, from one judgement."""
    moving = judged(s, rules, max_stage, texts=True)
    if daily_limit is not None:
        moving = steps._held(s, moving, daily_limit, as_of)
    rows = staged(with_contacts(moving, s.contacts), "run-rows")
    return RunTables(
        applications_after(s, rows, as_of), contacts_after(s, rows).drop("origin"), emails_after(s, rows, rules, as_of).drop("origin"),
        resumes_after(s, rows, as_of).drop("origin"), _dated(history_rows(rows, max_stage), run_id, as_of))


COMMITS = "number BIGINT, run_id STRING"


def _commits(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(COMMITS).parquet(f"{out}/commits")
    except AnalysisException:
        return spark.createDataFrame([], COMMITS)


def commit(tables: RunTables, out: str, run_id: str) -> None:
    """Store a run: its tables first, each in a folder of the run, then one row that makes them count.

    A run that dies before that row leaves the state of the run before; repeated, it overwrites what it wrote.
    """
    spark = tables.applications.sparkSession
    last = _commits(spark, out).agg(F.max("number")).first()[0]
    for f in fields(tables):
        getattr(tables, f.name).write.mode("overwrite").parquet(f"{out}/runs/{run_id}/{f.name}")
    spark.createDataFrame([(0 if last is None else last + 1, run_id)], COMMITS).coalesce(1).write.mode("append").parquet(f"{out}/commits")


def latest(spark: SparkSession, out: str) -> RunTables | None:
    """The tables of the last committed run; null when there is none."""
    last = _commits(spark, out).orderBy(F.desc("number")).first()
    if last is None:
        return None
    return RunTables(*[spark.read.parquet(f"{out}/runs/{last['run_id']}/{f.name}") for f in fields(RunTables)])
