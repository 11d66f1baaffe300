"""Incremental export of outreach records to JSON and CSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.display import body_preview, score_or_null
from hirelake.functions.text import or_text
from hirelake.operators.keys import lookup
from hirelake.operators.reporting import latest_per_application

# Records repeat their field names and most of their words; readers unpack by the file's ending.
CODEC = "gzip"
MANIFEST_SCHEMA = "application_id BIGINT"


def records(applications: DataFrame, jobs: DataFrame, companies: DataFrame, contacts: DataFrame,
            emails: DataFrame) -> DataFrame:
    """One 19-column record per application.

    ``N/A`` stands for a missing parent, a missing or empty contact mailbox or draft id, and a
    missing update time. A null attribute of a present parent stays null. Messages and jobs of other applications
    are left out before anything is aggregated or joined.
    """
    ids = applications.select(F.col("id").alias("application_id"))
    mail = latest_per_application(emails.select(
        "id", "application_id", "subject", "body", "gmail_draft_id").join(ids, "application_id", "left_semi")).select(
        F.col("application_id").alias("id"), F.struct("subject", "body", "gmail_draft_id").alias("m"))
    wanted = applications.select(F.col("job_id").alias("id")).distinct()
    j = jobs.join(wanted, "id", "left_semi").select(
        F.col("id").alias("job_id"), "company_id", F.struct("title", "location", "salary").alias("j"))
    c = companies.select(F.col("id").alias("company_id"),
                         F.struct("name", "domain", "industry", "employee_count").alias("c"))
    p = contacts.select(F.col("id").alias("_cid"), F.struct("name", "role", "email").alias("p"))
    rows = applications.join(mail, "id", "left").join(j, "job_id", "left")
    rows = lookup(rows, c, ["company_id"], ["company_id"], "id")
    rows = lookup(rows, p, ["contact_id"], ["_cid"], "id")

    def of(parent: str, field: str):
        value = F.col(f"{parent}.{field}").cast("string")
        return F.when(F.col(parent).isNull(), "N/A").otherwise(value)

    return rows.select(
        F.col("id").alias("application_id"), "run_id",
        of("c", "name").alias("company_name"), of("c", "domain").alias("company_domain"),
        of("c", "industry").alias("company_industry"),
        of("c", "employee_count").alias("company_employee_count"),
        of("j", "title").alias("job_title"), of("j", "location").alias("job_location"),
        of("j", "salary").alias("job_salary"), of("p", "name").alias("contact_name"),
        of("p", "role").alias("contact_role"), or_text("p.email", "N/A").alias("contact_email"),
        of("m", "subject").alias("email_subject"),
        F.coalesce(body_preview("m.body"), F.lit("N/A")).alias("email_body_preview"),
        or_text("m.gmail_draft_id", "N/A").alias("gmail_draft_id"),
        F.col("state").alias("application_state"), "current_stage",
        score_or_null("score").alias("score"),
        F.coalesce(F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A")).alias("updated_at"))


def pending(applications: DataFrame, exported: DataFrame) -> DataFrame:
    """Applications whose id is not in the manifest."""
    done = exported.select(F.col("application_id").alias("id")).distinct()
    return applications.join(done, "id", "left_anti")


COMMITS = "pass BIGINT, stamp STRING, base BIGINT, new BIGINT, total BIGINT"


def _commits(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(COMMITS).parquet(f"{out}/commits")
    except AnalysisException:
        return spark.createDataFrame([], COMMITS)


def commits(spark: SparkSession, out: str) -> DataFrame:
    """The passes that count, one row each: ``(pass, stamp, base, new, total)``."""
    return _commits(spark, out)


def read_manifest(spark: SparkSession, out: str, last: Row | None = None) -> DataFrame:
    """Ids exported by the passes that count, from the base of the last one on; empty before the first."""
    last = last or _commits(spark, out).orderBy(F.desc("pass")).first()
    if last is None:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    ids = spark.read.schema(MANIFEST_SCHEMA + ", pass BIGINT").parquet(f"{out}/ids")
    return ids.where(F.col("pass").between(last["base"], last["pass"])).select("application_id")


def read_latest(spark: SparkSession, out: str) -> DataFrame | None:
    """The cumulative records of the last pass that counts."""
    last = _commits(spark, out).orderBy(F.desc("pass")).first()
    return None if last is None else spark.read.option("header", True).csv(f"{out}/latest/pass={last['pass']}")


@dataclass(frozen=True)
class Exported:
    number: int
    new: int
    total: int


def export(applications: DataFrame, jobs: DataFrame, companies: DataFrame, contacts: DataFrame,
           emails: DataFrame, out: str, stamp: str, export_all: bool = False) -> Exported:
    """One pass: new records as JSON and CSV, all exported ones as a new cumulative CSV, then the commit.

    A pass writes only folders of its own number; the row appended to ``commits`` at the end makes them count, so a
    pass that dies at any step leaves the state before it and is overwritten by the next one. Ids are picked
    before anything is joined. Files are sorted by update time and packed (:data:`CODEC`). Nothing is written when nothing is new.
    With ``export_all`` earlier passes are forgotten.
    """
    spark = applications.sparkSession
    last = _commits(spark, out).orderBy(F.desc("pass")).first()
    number = 0 if last is None else last["pass"] + 1
    fresh_start = export_all or last is None
    done = spark.createDataFrame([], MANIFEST_SCHEMA) if fresh_start else read_manifest(spark, out, last)
    pending(applications, done).select(F.col("id").alias("application_id")) \
        .write.mode("overwrite").parquet(f"{out}/ids/pass={number}")
    ids = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{out}/ids/pass={number}")
    new, before = ids.count(), 0 if fresh_start else last["total"]
    if new == 0:
        return Exported(number, 0, before)
    chosen = done.withColumn("_new", F.lit(False)).unionByName(ids.withColumn("_new", F.lit(True))).withColumnRenamed("application_id", "id")
    listed = records(applications.join(chosen.select("id"), "id", "left_semi"), jobs, companies, contacts, emails) \
        .join(chosen.withColumnRenamed("id", "application_id"), "application_id")
    path = f"{out}/records/pass={number}"
    listed.write.mode("overwrite").parquet(path)
    # Sorted once for all files. What an executor loses of it is sorted again from the records.
    ordered = spark.read.schema(listed.schema).parquet(path).orderBy("updated_at", "application_id").persist(StorageLevel.DISK_ONLY)
    try:
        fresh = ordered.where("_new").drop("_new")
        fresh.write.mode("overwrite").json(f"{out}/export_{stamp}.json", compression=CODEC)
        fresh.write.mode("overwrite").csv(f"{out}/export_{stamp}.csv", header=True, compression=CODEC)
        ordered.drop("_new").write.mode("overwrite").csv(f"{out}/latest/pass={number}", header=True, compression=CODEC)
    finally:
        ordered.unpersist()
    made = Exported(number, new, before + new)
    row = (number, stamp, number if fresh_start else last["base"], new, made.total)
    spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").parquet(f"{out}/commits")
    return made
