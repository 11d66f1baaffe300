"""One key holds a third of all rows: joins are split, results stay whole."""

import pytest
from pyspark.sql import functions as F

from hirelake.operators import cache, fetchlog, filtering, outreach, reporting, resolution
from hirelake.rules import Rules

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}
ROWS = 120_000


@pytest.fixture
def tight(spark):
    """AQE thresholds scaled down to the test data."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k in SETTINGS:
        spark.conf.unset(k)


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def hot():
    """A key column: every third row shares key 7, the others are spread."""
    n = F.col("id")
    return F.when(n % 3 == 0, F.lit(7)).otherwise(n % 5000)


def test_mail_lookup_splits_the_hot_domain(tight):
    people = tight.range(0, ROWS, 1, 16).select(
        "id", F.concat(F.lit("p"), "id", F.lit("@d"), hot().cast("string"), F.lit(".com")).alias("email"))
    domains = tight.range(0, 5000).select(F.concat(F.lit("d"), "id", F.lit(".com")).alias("domain"), (F.col("id") % 2 == 0).alias("accepts_mail"))
    rows, plan = executed(outreach.mail_verdicts(people, domains).where("verdict = 'domain'").select("id"))
    assert "skew=true" in plan
    want = {i for i in range(ROWS) if (7 if i % 3 == 0 else i % 5000) % 2 == 1}
    assert {r["id"] for r in rows} == want


def test_cache_lookup_splits_the_hot_key(tight):
    asked = tight.range(0, ROWS, 1, 16).select("id", hot().cast("string").alias("key"), F.md5(F.col("id").cast("string")).alias("pad"))
    entries = cache.upsert(tight.range(0, 200).select(
        (F.col("id") % 100).cast("string").alias("key"), F.lit("v").alias("value"), F.col("id").alias("version"),
        F.lit("2030-01-01").cast("timestamp_ntz").alias("expires_at")))
    rows, plan = executed(cache.lookup(asked, entries, "2024-01-01 00:00:00"))
    assert "skew=true" in plan
    assert len(rows) == ROWS and sum(r["hit"] for r in rows) == sum(
        (7 if i % 3 == 0 else i % 5000) < 100 for i in range(ROWS))


def test_hot_company_and_unlinked_contacts(tight):
    apps = tight.range(0, ROWS, 1, 16).select(
        "id", F.lit("r").alias("run_id"), F.col("id").alias("job_id"),
        F.when(F.col("id") % 3 != 0, F.lit(None)).otherwise(F.col("id") % 10).cast("bigint").alias("contact_id"),
        F.lit(3).alias("current_stage"), F.lit("Company Research").alias("state"), F.lit(0.5).alias("score"),
        F.md5(F.col("id").cast("string")).alias("tailored_resume_path"), F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    jobs = tight.range(0, ROWS, 1, 16).select("id", hot().cast("bigint").alias("company_id"), F.lit("t").alias("title"))
    companies = tight.range(0, 5000).select("id", F.concat(F.lit("c"), "id").alias("name"))
    contacts = tight.range(0, 10).select("id", F.lit("m@x.io").alias("email"))
    rows, plan = executed(reporting.full_list(apps, jobs, companies, contacts).select("id", "company_name", "contact_email"))
    assert "skew=true" in plan
    assert len(rows) == ROWS
    assert sum(r["contact_email"] == "N/A" for r in rows) == ROWS - ROWS // 3
    assert sum(r["company_name"] == "c7" for r in rows) >= ROWS // 3


def test_null_keys_are_spread(tight):
    """All-null contact ids must not meet in one partition of the join."""
    apps = tight.range(0, 20_000, 1, 8).select("id", F.lit(None).cast("bigint").alias("contact_id"))
    contacts = tight.range(0, 10).select("id", F.lit("m@x.io").alias("email"))
    joined = reporting.with_contact(apps, contacts, {"email": "contact_email"})
    tight.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        tight.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_entity_match_splits_the_hot_name(tight):
    targets = tight.range(0, ROWS, 1, 16).select(
        F.col("id").alias("target_id"), F.concat(F.lit("C"), hot().cast("string")).alias("name"),
        F.md5(F.col("id").cast("string")).alias("domain"))
    companies = tight.range(0, 1000).select("id", F.concat(F.lit("c"), "id").alias("name"), F.lit("d").alias("domain"))
    rows, plan = executed(resolution.match_companies(targets, companies))
    assert "skew=true" in plan
    assert len(rows) == ROWS
    assert sum(r["matched_by"] == "name" for r in rows) == sum((7 if i % 3 == 0 else i % 5000) < 1000 for i in range(ROWS))


def test_breaker_and_denylist_split_the_hot_domain(tight):
    log = tight.range(0, ROWS, 1, 16).select(
        "id", F.concat(F.lit("d"), hot().cast("string")).alias("domain"), F.lit(1).alias("run_day"),
        F.col("id").alias("ts"), (F.col("id") % 2 == 0).alias("ok"), F.md5(F.col("id").cast("string")).alias("pad"))
    rows, plan = executed(fetchlog.with_breaker(log, Rules()))
    assert "skew=true" in plan and len(rows) == ROWS
    late = [r for r in rows if r["domain"] == "d7" and r["disabled"]]
    assert len(late) >= ROWS // 3 - 10
    pages = log.select("id", F.concat(F.lit("http://"), "domain").alias("url"), "pad")
    denied = tight.createDataFrame([("d7",), ("d8",)], "domain STRING")
    rows, plan = executed(filtering.drop_denied(pages, denied, ()))
    assert "skew=true" in plan
    assert len(rows) == sum((7 if i % 3 == 0 else i % 5000) not in (7, 8) for i in range(ROWS))
