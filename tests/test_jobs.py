"""Table jobs on small hand-made tables, several of them against plain-Python reference loops."""

import json
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.operators import (
    audit,
    cache,
    export,
    fetchlog,
    filtering,
    generate,
    hygiene,
    keys,
    outreach,
    reporting,
    resolution,
    responses,
)
from hirelake.plans import advance, discovery, outcomes, run
from hirelake.rules import RUN_TERMINAL, Rules
from hirelake.sources import scans
from hirelake.sources.schemas import RESPONSES
from tests_shapes import APPLICATION, COMPANY, CONTACT, EMAIL, HISTORY, JOB, RESUME

RULES = Rules(excluded_companies=("dislike",), excluded_title_words=("Unpaid",), allow_speculative=True)
DAY = datetime(2024, 1, 2, 9)


@pytest.fixture
def shop(spark):
    """The hygiene and export case: one company, two contacts, two applications."""
    return {
        "companies": spark.createDataFrame([(1, "Acme Corp", "mocktech.com", "Tech", 100)], COMPANY),
        "jobs": spark.createDataFrame([(10, 1, "AI Engineer", "Remote", "30 LPA", None, None)], JOB),
        "contacts": spark.createDataFrame([
            (100, 1, "John Doe", "Tech Lead", "invalid-email-no-mx-12345.xyz"),
            (101, 1, "Jane Smith", "CTO", "jane@mocktech.com")], CONTACT),
        "applications": spark.createDataFrame([
            (1, "RUN-1", 10, 100, 3, "Professional Email Discovery", 8.5, None, DAY),
            (2, "RUN-1", 10, 101, 10, "Completed", 9.2, None, DAY)], APPLICATION),
        "emails": spark.createDataFrame([(50, 2, "Hi Jane", "<p>Hello world</p>", "DRAFT-123", "draft_created", DAY)], EMAIL),
        "mx": spark.createDataFrame([("mocktech.com", True), ("invalid-email-no-mx-12345.xyz", False)], "domain STRING, accepts_mail BOOLEAN")}


def test_cleaning_never_removes_rows(shop, rows):
    contacts = hygiene.clean_contacts(shop["contacts"], shop["mx"])
    assert rows(contacts, "id", "email") == [(100, None), (101, "jane@mocktech.com")]
    apps = hygiene.clean_applications(shop["applications"], contacts)
    assert rows(apps, "id", "state") == [(1, "No Professional Email"), (2, "Completed")]
    assert tuple(hygiene.clean_summary(contacts, apps).first()) == (1, 1)


def test_export_is_incremental(spark, shop, tmp_path):
    args = [shop[t] for t in ("applications", "jobs", "companies", "contacts", "emails")]
    out = str(tmp_path / "exports")
    assert export.export(*args, out, "a") == export.Exported(0, 2, 2)
    assert export.export(*args, out, "b") == export.Exported(1, 0, 2)
    assert not (tmp_path / "exports" / "export_b.json").exists()
    more = shop["applications"].unionByName(spark.createDataFrame(
        [(3, "RUN-2", 10, None, 2, "Filtering", 0.0, None, DAY)], APPLICATION))
    assert export.export(more, *args[1:], out, "c") == export.Exported(1, 1, 3)
    record = spark.read.json(f"{out}/export_c.json").first()
    assert (record["contact_email"], record["email_subject"], record["company_name"]) == ("N/A", "N/A", "Acme Corp")
    assert "score" not in record.asDict() or record["score"] is None
    latest = export.read_latest(spark, out)
    assert latest.count() == 3 and len(latest.columns) == 19
    assert export.export(more, *args[1:], out, "d", export_all=True) == export.Exported(2, 3, 3)
    assert export.read_manifest(spark, out).count() == 3


def test_a_pass_that_dies_leaves_the_state_before(spark, shop, tmp_path):
    args = [shop[t] for t in ("applications", "jobs", "companies", "contacts", "emails")]
    out = str(tmp_path / "exports")
    assert export.read_manifest(spark, out).count() == 0 and export.read_latest(spark, out) is None
    spark.createDataFrame([(1,), (2,), (9,)], "application_id BIGINT").write.parquet(f"{out}/ids/pass=0")  # before its commit
    assert export.read_manifest(spark, out).count() == 0
    assert export.export(*args, out, "a") == export.Exported(0, 2, 2)
    spark.createDataFrame([(7,)], "application_id BIGINT").write.parquet(f"{out}/ids/pass=1")
    export.read_latest(spark, out).write.option("header", True).csv(f"{out}/latest/pass=1")
    assert sorted(r[0] for r in export.read_manifest(spark, out).collect()) == [1, 2]
    assert export.read_latest(spark, out).count() == 2
    assert export.commits(spark, out).count() == 1


def test_export_files_are_sorted_once_and_packed(spark, shop, tmp_path):
    many = spark.range(500).select(
        "id", F.lit("RUN-1").alias("run_id"), F.lit(10).cast("bigint").alias("job_id"), F.lit(None).cast("bigint").alias("contact_id"),
        F.lit(3).cast("bigint").alias("current_stage"), F.lit("Filtering").alias("state"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("string").alias("tailored_resume_path"),
        (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(F.pmod(F.col("id") * 37, F.lit(50)).cast("int"))).alias("updated_at"))
    out = str(tmp_path / "exports")
    args = [shop[t] for t in ("jobs", "companies", "contacts", "emails")]
    export.export(many.where("id < 200"), *args, out, "a")
    export.export(many, *args, out, "b")
    for name, n in (("export_a.json", 200), ("export_b.json", 300), ("export_b.csv", 300), ("latest/pass=1", 500)):
        parts = sorted((tmp_path / "exports" / name).glob("part-*"))
        assert parts and all(part.name.endswith(".gz") for part in parts)
        read = spark.read.json if "json" in name else spark.read.option("header", True).csv
        got = [(r["updated_at"], int(r["application_id"])) for part in parts for r in read(str(part)).collect()]
        assert len(got) == n and got == sorted(got)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_audit_rows_are_narrow(spark, rows):
    tables = {
        "companies": spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (None, None)], "id BIGINT, name STRING"),
        "jobs": spark.createDataFrame([(1, 1, "u"), (2, 7, "u"), (3, None, None), (7, 7, "w")], "id INT, company_id INT, url STRING"),
        "contacts": spark.createDataFrame([("x", 2, "m"), ("x", 9, "m"), ("z", 1, None)], "id STRING, company_id BIGINT, email STRING"),
        "applications": spark.createDataFrame([(1, "r", "3", "x"), (2, "r", "4", "9")], "id BIGINT, run_id STRING, job_id STRING, contact_id STRING")}
    found = audit.integrity(tables)
    assert dict(rows(found)) == {
        "unique companies.id": 1, "unique companies.name": 1, "unique jobs.id": 0, "unique jobs.url": 1, "unique contacts.id": 1,
        "unique contacts.email": 1, "unique applications.id": 0, "reference jobs.company_id": 2, "reference contacts.company_id": 1,
        "reference applications.job_id": 1, "reference applications.contact_id": 1}
    plan = found._jdf.queryExecution().executedPlan().toString()
    grouped = next(line for line in plan.splitlines() if "keys=[space" in line and "partial_count" in line)
    assert grouped.count("partial_count(") == 3  # keys, and two references to one parent at most
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_rows_of_a_run_are_settled_once(spark, rows, tmp_path):
    contact = advance.CONTACT
    moved = spark.createDataFrame(
        [(1, 5, "Acme", None, 3, 7, None, None, "a@x.com", None), (2, 5, "Acme", None, 3, 7, None, (None, "p", "r", None), "b@x.com", None)],
        f"id BIGINT, company_id BIGINT, company_name STRING, contact_id BIGINT, start INT, end INT, linked {contact}, contact {contact}, "
        "guess STRING, owner BIGINT")
    moved.write.parquet(str(tmp_path / "settled"))
    contacts = spark.createDataFrame([(40, 1, "Jo", "CTO", None)], CONTACT)
    out = advance.with_contacts(spark.read.parquet(str(tmp_path / "settled")), contacts)
    assert rows(out, "id", "own_contact", "final_contact") == [(1, 41, 41), (2, 41, 41)]
    # The rows come from what was written of them, not from the plan that settled them.
    assert not [f for f in out.inputFiles() if "/settled/" in f]


def test_status_report(spark, rows):
    companies = spark.createDataFrame([(1, "Acme Corp", None, None, None)], COMPANY)
    jobs = spark.createDataFrame([(10, 1, "Senior Engineer", None, None, None, None)], JOB)
    apps = spark.createDataFrame([(100, "RUN-1", 10, None, 3, "Company Research", 8.5, None, DAY)], APPLICATION)
    runs = spark.createDataFrame([("RUN-1", "running")], "id STRING, status STRING")
    row = reporting.active_list(apps, jobs, companies, "2024-01-02 09:00:30").first()
    assert (row["company_name"], row["job_title"], row["stage_name"], row["stage_percent"], row["updated_ago"]) == (
        "Acme Corp", "Senior Engineer", "Company Research", 25, "Just now")
    assert reporting.running_runs(runs).first()[0] == 1
    assert reporting.company_list(companies).first()["employee_count"] == "N/A"


def test_detail_report(spark):
    companies = spark.createDataFrame([(1, "TechCorp", "techcorp.com", "AI", 150)], COMPANY)
    jobs = spark.createDataFrame([(10, 1, "AI Architect", "Remote", "₹30L", None, None)], JOB)
    contacts = spark.createDataFrame([(5, 1, "Alice Smith", "VP Eng", "alice@techcorp.com")], CONTACT)
    apps = spark.createDataFrame([(101, "RUN-99", 10, 5, 10, "Gmail Draft Creation", 9.2, "resumes/generated/t.pdf", DAY),
                                  (102, "RUN-99", 10, None, 3, "Company Research", None, None, DAY)], APPLICATION)
    emails = spark.createDataFrame([(1, 101, "old", "b", None, "generated", DAY),
                                    (2, 101, "AI Architect Role", "b", "r12345", "draft_created", DAY)], EMAIL)
    resumes = spark.createDataFrame([(1, 101, "base.typ", "resumes/generated/t.pdf")], RESUME)
    history = spark.createDataFrame([(1, 101, 10, "Gmail Draft Creation", DAY)], HISTORY)
    row = reporting.application_details(101, apps, jobs, companies, contacts, emails, resumes, history).first()
    assert (row["company_name"], row["contact_name"], row["email_draft_id"], row["resume_path"], row["history_rows"]) == (
        "TechCorp", "Alice Smith", "r12345", "resumes/generated/t.pdf", 1)
    listed = {r["id"]: r for r in reporting.full_list(apps, jobs, companies, contacts).collect()}
    assert listed[101]["resume_file"] == "t.pdf" and listed[102]["contact_email"] == "N/A"


def test_next_run_id(spark, rows):
    runs = spark.createDataFrame([("RUN-20240101-999",), ("RUN-20240101-1000",), ("RUN-20240102-x",), ("OTHER",)], "id STRING")
    assert rows(reporting.next_run_ids(runs)) == [
        ("RUN-20240101-", "RUN-20240101-1001"), ("RUN-20240102-", "RUN-20240102-001")]


def test_weighted_score(spark):
    df = spark.createDataFrame([(1.0, .8, .5, .7, .6, .9)], ", ".join(f"{c} DOUBLE" for c in Rules.COMPONENTS))
    row = reporting.weighted_scores(df, Rules()).first()
    assert row["score"] == pytest.approx(0.81) and row["passes"]


def test_screening_and_reentry(spark, rows):
    companies = spark.createDataFrame([(1, "Good", None, None, 1), (2, "I Dislike This", None, None, 1)], COMPANY)
    jobs = spark.createDataFrame([
        (1, 1, "Dev", None, None, None, None), (2, 1, "UNPAID intern", None, None, None, None),
        (3, 1, "Dev", None, None, None, 1.5), (4, 2, "unpaid", None, None, None, 9.0),
        (5, 1, "Dev", None, None, None, 0.0), (6, 1, "Dev", None, None, None, None), (7, 1, "Dev", None, None, None, None)], JOB)
    got = rows(filtering.screen(jobs, companies, RULES), "job_id", "state", "current_stage")
    assert got == [(1, "Company Research", 3), (2, "Ghost Job", 2), (3, "Ghost Job", 2), (4, "Excluded Company", 2),
                   (5, "Company Research", 3), (6, "Company Research", 3), (7, "Company Research", 3)]
    apps = spark.createDataFrame([(60, "r", 6, None, 4, "Duplicate", None, None, DAY),
                                  (61, "r", 6, None, 3, "Completed", None, None, DAY),
                                  (70, "r", 7, None, 2, "Ghost Job", None, None, DAY)], APPLICATION)
    entered = filtering.enter_screening(jobs, companies, apps, RULES)
    assert rows(entered, "job_id", "application_id", "state", "is_new") == [
        (1, None, "Company Research", True), (2, None, "Ghost Job", True), (3, None, "Ghost Job", True),
        (4, None, "Excluded Company", True), (5, None, "Company Research", True), (6, 60, "Duplicate", False)]
    assert rows(filtering.admitted(entered), "job_id", "note") == [(1, "passed screening"), (5, "passed screening"), (6, None)]
    targets = spark.createDataFrame([(2,)], "id BIGINT")
    assert filtering.admitted(advance.targeted_entries(jobs, companies, apps, RULES, targets)).count() == 0
    freed = advance.targeted_entries(jobs.where("id = 4").withColumn("title", F.lit("Dev")).withColumn(
        "experience_years_required", F.lit(0.5)), companies, apps, RULES, targets, honour_exclusions=False)
    assert freed.count() == 1


def test_resume_or_discover(spark):
    apps = spark.createDataFrame([(1, "r", 1, None, 3, "Failed", None, None, DAY)], APPLICATION)
    found = spark.createDataFrame([(2, "r", 1, None, 3, "Company Research", None, None, DAY)], APPLICATION)
    assert filtering.resume_or_discover(apps, found).first()["id"] == 2
    assert filtering.resume_or_discover(found, apps).first()["id"] == 2


def test_upserts_against_loop(spark, rows):
    rng = random.Random(3)
    stored = [(i, f"n{i}", f"u{i}" if i % 3 else None) for i in range(1, 40)]
    found = [(i, f"n{min(rng.randrange(90), rng.randrange(90))}", rng.choice([None, " ", f" u{rng.randrange(60)} "]))
             for i in range(400)]
    table = spark.createDataFrame(stored, "id BIGINT, name STRING, url STRING")
    incoming = spark.createDataFrame(found, "ordinal BIGINT, name STRING, url STRING").repartition(7)

    seen, ids, nxt = {}, {n: i for i, n, _ in stored}, 40
    for _, name, _ in found:
        if name not in seen:
            seen[name] = (ids.get(name, nxt), name, name not in ids)
            nxt += name not in ids
    assert rows(resolution.upsert_companies(table, incoming), "id", "name", "is_new") == sorted(seen.values(), key=repr)

    out, urls, nxt, ids = [], set(), 40, {u: i for i, _, u in stored if u}
    for _, _, url in found:
        url = (url or "").strip() or None
        if url in urls:
            continue
        if url:
            urls.add(url)
        fresh = url not in ids
        out.append((nxt if fresh else ids[url], url, fresh))
        nxt += fresh
    assert rows(resolution.upsert_jobs(table, incoming), "id", "url", "is_new") == sorted(out, key=repr)


def test_discovery_reuses_stored_rows(spark, rows):
    companies = spark.createDataFrame([(1, "Acme", None, None, 1)], COMPANY)
    jobs = spark.createDataFrame([(10, 1, "Stored Dev", None, None, "http://a.io/1", None)], JOB)
    apps = spark.createDataFrame([(5, "r", 10, None, 4, "Contact Research", None, None, DAY)], APPLICATION)
    found = spark.createDataFrame([(0, "New Co"), (1, "Acme"), (2, "New Co"), (3, "I Dislike Co")], "ordinal BIGINT, name STRING")

    def job(title, url, years=None):
        return {"title": title, "url": url, "location": None, "salary": None, "experience_years": years, "description": None}

    raw = json.dumps({"jobs": [job("Dev", " http://a.io/1 "), job("Ops", " "), job("Ops", None), job("Boss", "http://a.io/2", 9)]})
    answers = spark.createDataFrame([(1, raw), (99, raw)], "company_id BIGINT, raw STRING")
    run = discovery.discover(companies, jobs, apps, found, answers, RULES)
    assert rows(run.companies, "id", "name", "is_new") == [(1, "Acme", False), (2, "New Co", True), (3, "I Dislike Co", True)]
    assert rows(run.jobs, "id", "company_id", "url", "is_new") == [
        (10, 1, "http://a.io/1", False), (11, 2, "speculative://new_co", True), (12, 1, None, True), (13, 1, None, True),
        (14, 1, "http://a.io/2", True), (15, 3, "speculative://i_dislike_co", True)]
    assert rows(run.entered, "job_id", "application_id", "is_new") == [
        (10, 5, False), (11, None, True), (12, None, True), (13, None, True), (14, None, True), (15, None, True)]
    assert rows(run.entered.where("current_stage = 2"), "job_id", "state") == [(14, "Ghost Job"), (15, "Excluded Company")]


def test_ordinals_and_positions_of_any_size(spark):
    found = spark.createDataFrame([(2**43 + 1, 0, "a"), (2**43, 2**20 + 5, "b"), (2**43, 7, "c"), (5, 2**30, "d")],
                                  "ordinal BIGINT, pos INT, url STRING")
    got = resolution.upsert_jobs(spark.createDataFrame([(9, None)], "id BIGINT, url STRING"), found, minor="pos")
    assert sorted((r["id"], r["url"]) for r in got.collect()) == [(10, "d"), (11, "c"), (12, "b"), (13, "a")]


@pytest.mark.parametrize("step", [1, 3, 2**40 + 7])
def test_dense_ids_over_many_ranges(spark, monkeypatch, step):
    monkeypatch.setattr(keys, "RANGE_BITS", 3)
    df = spark.range(0, 500).select((F.col("id") * step - 900).alias("ordinal")).repartition(5)
    top = spark.createDataFrame([(100,)], "m BIGINT")
    got = keys.dense_ids(df, "ordinal", "new_id", top).orderBy("ordinal").collect()
    assert [r["new_id"] for r in got] == list(range(101, 601))


def test_many_positions_under_one_ordinal(spark, monkeypatch):
    """Positions of one ordinal are numbered in ranges of their own."""
    monkeypatch.setattr(keys, "RANGE_BITS", 3)
    pairs = [(7, p) for p in range(300)] + [(6, 2), (6, 900), (8, 0), (-4, 5)]
    df = spark.createDataFrame(pairs, "ordinal BIGINT, pos INT").repartition(5)
    got = keys.dense_ids(df, "ordinal", "new_id", spark.createDataFrame([(0,)], "m BIGINT"), minor="pos")
    assert [(r["ordinal"], r["pos"]) for r in got.orderBy("new_id").collect()] == sorted(pairs)
    assert sorted(r["new_id"] for r in got.collect()) == list(range(1, len(pairs) + 1))
    assert "hashpartitioning(_range" in got._jdf.queryExecution().executedPlan().toString()


def test_entity_match(spark, rows):
    companies = spark.createDataFrame([(1, "Acme", "acme.io", None, 1), (2, "acme", "other.io", None, 1), (3, "B_t", None, None, 1)], COMPANY)
    targets = spark.createDataFrame([(1, "ACME", None), (2, "Nope", "OTHER.io"), (3, "Nope", None), (4, "Bat", None)],
                                    "target_id INT, name STRING, domain STRING")
    assert rows(resolution.match_companies(targets, companies)) == [
        (1, 1, "name"), (2, 2, "domain"), (3, None, "new"), (4, None, "new")]


def test_speculative_switch(spark):
    companies = spark.createDataFrame([(1, "No Jobs", None, None, 1)], COMPANY)
    jobs = spark.createDataFrame([], JOB)
    row = resolution.speculative_jobs(companies, jobs, RULES).first()
    assert row["url"] == "speculative://no_jobs" and row["title"] == "Software Engineer (Speculative Application)"
    assert resolution.speculative_jobs(companies, jobs, Rules()).count() == 0


def test_best_contact_ties_and_unlisted_roles(spark, rows):
    contacts = spark.createDataFrame([
        (3, 1, "c", "CTO", None), (1, 1, "a", "Senior Recruiter", None), (2, 1, "b", "cto & founder", None),
        (4, 2, "d", "Gardener", None), (5, 3, "e", None, None), (6, 3, "f", "HR", None)], CONTACT)
    assert rows(outreach.best_contacts(contacts, Rules()), "company_id", "id", "rank") == [(1, 2, 4), (2, 4, 7), (3, 6, 6)]


def test_conflicts_against_loop(spark, rows):
    rng = random.Random(5)
    people = [(i, 1, "n", "r", rng.choice([None, "", "hot@x.io", "hot@x.io", f"m{rng.randrange(30)}@x.io"])) for i in range(200)]
    contacts = spark.createDataFrame(people, CONTACT)
    found = [(i, rng.choice([None, "hot@x.io", f"m{rng.randrange(30)}@x.io"])) for i in range(200)]
    want = []
    for cid, mailbox in found:
        owner = min((p[0] for p in people if mailbox and p[4] == mailbox and p[0] != cid), default=None)
        want.append((cid, cid if owner is None else owner, "set" if owner is None else "relink"))
    got = outreach.relink_conflicts(spark.createDataFrame(found, "contact_id BIGINT, email STRING"), contacts)
    assert rows(got, "contact_id", "linked_contact_id", "action") == sorted(want, key=repr)


def test_breaker_against_loop(spark, rows):
    rng = random.Random(7)
    log = [(i, rng.choice(["hot", "hot", "a", "b", ""]), rng.randrange(2), i // 3, rng.random() < .5) for i in range(300)]
    df = spark.createDataFrame(log, "id BIGINT, domain STRING, run_day INT, ts BIGINT, ok BOOLEAN")
    fails, want = {}, []
    for i, domain, day, ts, ok in sorted(log, key=lambda r: (r[3], r[0])):
        want.append((i, fails.get((day, domain), 0) >= 3))
        if not ok and domain:
            fails[day, domain] = fails.get((day, domain), 0) + 1
    assert rows(fetchlog.with_breaker(df, Rules()), "id", "disabled") == sorted(want, key=repr)


def test_blacklist(spark, rows):
    totals = spark.createDataFrame([("a", 0, 5), ("b", 1, 9), ("c", 0, 4)], "domain STRING, successes BIGINT, failures BIGINT")
    assert rows(fetchlog.blacklist(totals, Rules(seed_blocked=("seed.com",)))) == [("a",), ("seed.com",)]


ENTRY = "key STRING, value STRING, expires_at TIMESTAMP_NTZ, version BIGINT"
NOW = "2024-01-02 09:00:00"


def test_cache(spark, rows):
    at = datetime.fromisoformat(NOW)
    entries = cache.upsert(spark.createDataFrame([
        ("k", "old", datetime(2025, 1, 1), 1), ("k", '{"data": 123}', at, 2), ("late", "v", datetime(2024, 1, 2, 8, 59, 59), 1),
        ("empty", "[]", datetime(2025, 1, 1), 1)], ENTRY))
    asked = spark.createDataFrame([("k",), ("late",), ("empty",), ("none",)], "key STRING")
    strict = rows(cache.lookup(asked, entries, NOW), "key", "hit", "value")
    assert strict == [("empty", False, None), ("k", True, '{"data": 123}'), ("late", False, None), ("none", False, None)]
    lenient = rows(cache.lookup(asked, entries, NOW, treat_empty_as_miss=False), "key", "hit")
    assert ("empty", True) in lenient
    assert tuple(cache.expired_count(entries, NOW).first()) == (1, 3)
    assert rows(cache.clear_expired(entries, NOW), "key") == [("empty",), ("k",)]
    assert rows(cache.drop_key(entries, asked.where("key = 'k'")), "key") == [("empty",), ("late",)]


def test_fences(spark):
    raw = ['x ```json\n{"a": 1}\n``` y', "```\n{}\n```", ' {"a": 1} ', "```json broken", "``` a ``` ``` b ```"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i INT, raw STRING")
    got = [r[1] for r in sorted(df.select("i", responses.unfenced("raw")).collect())]
    assert got == ['{"a": 1}', "{}", '{"a": 1}', "```json broken", "a"]


def test_typed_responses(spark):
    def accepted(kind, *payloads):
        df = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "i INT, raw STRING")
        return [(r["accepted"], r["response"]) for r in responses.parse(df, "raw", RESPONSES[kind]).orderBy("i").collect()]

    company = {"name": "MockTech", "domain": None, "employee_count": 150, "industry": "SaaS"}
    missing = {k: v for k, v in company.items() if k != "domain"}
    got = accepted("company_list", {"companies": [company]}, {"companies": []}, {"companies": [missing]},
                   {"companies": [company, {**company, "employee_count": "many"}]}, {"companies": None}, {}, "[1]", "junk")
    assert [ok for ok, _ in got] == [True, True, False, False, False, False, False, False]
    assert got[0][1]["companies"][0]["employee_count"] == 150 and got[1][1]["companies"] == []

    score = dict.fromkeys(Rules.COMPONENTS, 0.5) | {"reasoning": "ok"}
    got = accepted("opportunity_score", score, score | {"salary": "0.5"}, score | {"salary": None}, score | {"salary": [1]})
    assert [ok for ok, _ in got] == [True, True, False, False]
    got = accepted("validation", {"is_valid": True, "errors": ["a", "b"]}, {"is_valid": False, "errors": []},
                   {"is_valid": "perhaps", "errors": []}, {"is_valid": True, "errors": "x"})
    assert [ok for ok, _ in got] == [True, True, False, False]
    assert got[0][1]["errors"] == ["a", "b"]
    got = accepted("email_discovery", {"email": None, "pattern_used": "p"}, {"email": "a@b.c"})
    assert [ok for ok, _ in got] == [True, False]
    assert accepted("company_list", {"companies": [{**company, "employee_count": 7.5}]})[0][0] is False


def test_every_response_schema_parses(spark):
    fill = {T.StringType: "s", T.DoubleType: 1.5, T.IntegerType: 3, T.BooleanType: True}

    def sample(kind):
        if isinstance(kind, T.StructType):
            return {f.name: sample(f.dataType) for f in kind.fields}
        if isinstance(kind, T.ArrayType):
            return [sample(kind.elementType)]
        return fill[type(kind)]

    for name, schema in RESPONSES.items():
        df = spark.createDataFrame([(json.dumps(sample(schema)),)], "raw STRING")
        row = responses.parse(df, "raw", schema).first()
        assert row["accepted"], name
        assert json.loads(json.dumps(row["response"].asDict(recursive=True))) == sample(schema)


def test_structured_generation_asks_only_misses_once(spark, rows, tmp_path):
    folder = str(tmp_path)

    class CountingProvider:
        """Leaves one file per asked prompt."""

        def generate(self, prompts, instruction):
            import uuid
            for _ in prompts:
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return [json.dumps({"k": len(p)}) if p != "bad" else "?" for p in prompts]

    schema = T.StructType([T.StructField("k", T.IntegerType(), nullable=False)])
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bad"), (4, "kept"), (5, "stale")], "id INT, prompt STRING")
    stored = spark.createDataFrame([("kept", '{"k": 99}', datetime(2025, 1, 1)), ("stale", '{"k": 98}', datetime(2020, 1, 1))],
                                   "key STRING, value STRING, expires_at TIMESTAMP_NTZ")
    out = generate.structured_generate(df, "prompt", schema, CountingProvider(), stored, NOW)
    assert rows(out, "id", "accepted", "response.k") == [(1, True, 2), (2, True, 2), (3, False, None), (4, True, 99), (5, True, 5)]
    assert out.where("accepted").count() == 4
    assert len(list(tmp_path.iterdir())) == 3  # aa, bad, stale


def test_offline_provider_fills_schemas(spark):
    schema = RESPONSES["opportunity_score"]
    df = spark.createDataFrame([("hello",), ("123",)], "prompt STRING")
    out = generate.structured_generate(df, "prompt", schema, generate.OfflineProvider(schema))
    assert {r["prompt"]: r["accepted"] for r in out.collect()} == {"hello": True, "123": False}


def test_log_scan(spark, tmp_path):
    lines = ['{"timestamp": "2024-01-01T00:00:00Z", "level": "INFO", "message": "m", "logger": "l"}',
             '{"timestamp": "2024-01-01T00:00:01Z", "level": "ERROR", "message": "x", "logger": "l", "run_id": "R", "retries": 2}',
             "{broken"]
    (tmp_path / "app.log").write_text("\n".join(lines))
    log = scans.read_log(spark, str(tmp_path / "app.log")).cache()
    assert log.count() == 3
    assert log.where("_corrupt_record IS NOT NULL").count() == 1
    assert log.where("run_id = 'R'").first()["retries"] == 2
    tail = scans.log_tail(log.where("level IS NOT NULL"), ["timestamp"], lines=1)
    assert tail.first()["level"] == "ERROR"


def test_log_rows_and_rejects(spark, tmp_path):
    lines = ['{"timestamp": "2024-01-01T00:00:00Z", "level": "INFO", "retries": 2, "other": [1]}', '{"level": "WARN"', "Traceback (most recent call last):",
             "", "   ", '{"level": "INFO", "retries": "x"}', '{"level": "A"} {"level": "B"}', '["level"]', "null", '{"message": "\\u00e9"}', "{}"]
    (tmp_path / "app.log").write_text("\n".join(lines) + "\n" + '{"level": "cut o')
    rows, rejects = scans.scan_log(spark.read.text(str(tmp_path / "app.log")))
    assert [(r["level"], r["retries"], r["message"]) for r in rows.collect()] == [("INFO", 2, None), (None, None, "\u00e9"), (None, None, None)]
    assert [r["line"] for r in rejects.collect()] == [lines[i] for i in (1, 2, 5, 6, 7, 8)] + ['{"level": "cut o']


def test_entity_scan_and_evolution(spark, tmp_path):
    path = str(tmp_path / "emails")
    spark.createDataFrame([(1, 2, "s")], "id BIGINT, application_id BIGINT, subject STRING").write.parquet(path)
    row = scans.read_entity(spark, path, "emails").first()
    assert row["subject"] == "s" and row["scheduled_at"] is None
    df = spark.createDataFrame([(1,)], "id INT")
    assert scans.add_missing(scans.add_missing(df, "x", "string"), "x", "string").columns == ["id", "x"]


def test_audit(spark, rows):
    companies = spark.createDataFrame([(1, "a", None, None, 1), (2, "a", None, None, 1)], COMPANY)
    jobs = spark.createDataFrame([(1, 1, "t", None, None, "u", None), (1, 9, "t", None, None, "u", None), (2, 9, "t", None, None, None, None)], JOB)
    got = dict(rows(audit.integrity({"companies": companies, "jobs": jobs})))
    assert got == {"unique companies.id": 0, "unique companies.name": 1, "unique jobs.id": 1, "unique jobs.url": 1,
                   "reference jobs.company_id": 2}


def snapshot(spark, apps, contacts=(), signals=None, emails=(), resumes=(), scores=None, companies=None, jobs=None):
    ids = [a[0] for a in apps]
    comp = ", ".join(f"{c} DOUBLE" for c in Rules.COMPONENTS)
    return advance.Snapshot(
        spark.createDataFrame(apps, APPLICATION),
        spark.createDataFrame(jobs or [(10, 1, "Software Engineer", "Remote", "12 LPA", "u", 0.5)], JOB),
        spark.createDataFrame(companies or [(1, "MockTech", "mocktech.com", "SaaS", 150)], COMPANY),
        spark.createDataFrame(list(contacts), CONTACT),
        spark.createDataFrame([("mocktech.com", True)], "domain STRING, accepts_mail BOOLEAN"),
        spark.createDataFrame(scores if scores is not None else [(i, .9, .9, .8, .8, .8, .9) for i in ids], f"application_id BIGINT, {comp}"),
        spark.createDataFrame(signals if signals is not None else [(i, True, True, True, True) for i in ids],
                              "application_id BIGINT, research_ok BOOLEAN, tailor_ok BOOLEAN, valid_ok BOOLEAN, draft_ok BOOLEAN"),
        spark.createDataFrame(list(emails), EMAIL), spark.createDataFrame(list(resumes), RESUME))


def app(i, stage, state, contact=None, job=10):
    return (i, "RUN-1", job, contact, stage, state, None, None, DAY)


ALICE = (5, 1, "Alice Developer", "Engineering Manager", None)


def test_one_application_reaches_the_end(spark):
    s = snapshot(spark, [app(1, 3, "Company Research")], [ALICE])
    row = advance.advance(s, Rules()).first()
    assert (row["current_stage"], row["state"], row["contact_id"], row["contact_email"]) == (
        12, "Completed", 5, "alice.developer@mocktech.com")
    assert row["score"] == pytest.approx(0.87)
    trail = run.history_of(s, Rules(), "RUN-7", NOW).orderBy("step").collect()
    assert [r["stage"] for r in trail] == list(range(4, 13))
    assert {(r["run_id"], r["timestamp"]) for r in trail} == {("RUN-7", datetime.fromisoformat(NOW))}
    assert [r["notes"] for r in trail][:3] == ["company researched", "contact: Alice Developer", "mailbox: alice.developer@mocktech.com"]


def test_placeholder_contact_is_used(spark):
    row = advance.advance(snapshot(spark, [app(1, 4, "Contact Research")]), Rules()).first()
    assert (row["state"], row["contact_id"], row["contact_email"]) == ("Completed", 1, "hiring.manager@mocktech.com")


GATES = [
    (3, "Company Research", None, (False, True, True, True), (3, "Research Failed")),
    (5, "Professional Email Discovery", None, (True,) * 4, (5, "Failed")),
    (7, "Resume Tailoring", 6, (True, False, True, True), (7, "Failed")),
    (8, "Email Generation", None, (True,) * 4, (8, "Failed")),
    (7, "Resume Tailoring", 6, (True, True, False, True), (9, "Validation Failed")),
    (7, "Resume Tailoring", 6, (True, True, None, True), (12, "Completed")),
    (7, "Resume Tailoring", 6, (True, True, True, False), (10, "Draft Failed")),
    (9, "Validation", 6, (True,) * 4, (9, "Validation Failed")),
    (10, "Gmail Draft Creation", 6, (True,) * 4, (10, "Draft Failed")),
    (10, "Gmail Draft Creation", None, (True,) * 4, (10, "Failed")),
    (11, "Database Finalization", None, (False,) * 4, (12, "Completed")),
    (2, "Filtering", None, (True,) * 4, (2, "Filtering")),
    (4, "Failed", None, (True,) * 4, (4, "Failed")),
]


def test_gates(spark):
    """Stage, state, contact and outcomes of a row, and where one run takes it."""
    known = (6, 1, "Bob Known", "CTO", "bob@mocktech.com")
    apps = [app(i, stage, state, contact) for i, (stage, state, contact, _, _) in enumerate(GATES)]
    s = snapshot(spark, apps, [ALICE, known], [(i, *g[3]) for i, g in enumerate(GATES)])
    got = {r["id"]: (r["current_stage"], r["state"]) for r in advance.advance(s, Rules()).collect()}
    assert got == {i: g[4] for i, g in enumerate(GATES)}


def test_score_gate(spark):
    low = snapshot(spark, [app(1, 6, "Opportunity Scoring", 5)], [ALICE], scores=[(1, .1, .1, .1, .1, .1, .1)])
    none = snapshot(spark, [app(1, 6, "Opportunity Scoring", 5)], [ALICE], scores=[])
    assert advance.advance(low, Rules()).first()["state"] == "Salary Too Low"
    assert advance.advance(none, Rules()).first()["state"] == "Failed"


def test_duplicate_guard_counts_empty_mailboxes(spark):
    first = (4, 1, "First", "HR", "")
    s = snapshot(spark, [app(1, 4, "Contact Research"), app(2, 12, "Completed", 4)], [first, ALICE])
    assert advance.advance(s, Rules()).where("id = 1").first()["state"] == "Duplicate"


def test_max_stage_and_skip(spark):
    known = (6, 1, "Bob Known", "CTO", "bob@mocktech.com")
    s = snapshot(spark, [app(1, 4, "Contact Research", 6), app(2, 4, "Contact Research", 5), app(3, 9, "Validation", 6)], [ALICE, known])
    got = {r["id"]: (r["current_stage"], r["state"]) for r in advance.advance(s, Rules(), max_stage=4).collect()}
    assert got == {1: (6, "Opportunity Scoring"), 2: (5, "Professional Email Discovery"), 3: (9, "Validation")}
    trail = run.history_of(s, Rules(), "RUN-7", NOW, max_stage=5)
    assert [(r["application_id"], r["stage"]) for r in trail.collect()] == [(2, 6)]


def test_conflicting_mailbox_relinks(spark):
    owner = (9, 1, "Other", "HR", "alice.developer@mocktech.com")
    s = snapshot(spark, [app(1, 5, "Professional Email Discovery", 5)], [ALICE, owner])
    row = advance.advance(s, Rules()).first()
    assert (row["contact_id"], row["contact_email"]) == (9, "alice.developer@mocktech.com")


def test_finished_rows_do_not_move(spark):
    apps = [app(i, 3 + i % 9, state) for i, state in enumerate(RUN_TERMINAL, start=1)]
    got = advance.advance(snapshot(spark, apps, [ALICE]), Rules())
    assert sorted((r["id"], r["current_stage"], r["state"]) for r in got.collect()) == [(a[0], a[4], a[5]) for a in apps]


def test_targeted_links_the_supplied_contact(spark):
    given = (7, 1, "Hiring", "Decision Maker", "hiring@mocktech.com")
    companies = [(1, "MockTech", "mocktech.com", "SaaS", 150), (2, "Else", "else.com", "SaaS", 1)]
    jobs = [(10, 1, "Dev", None, None, None, None), (20, 2, "Dev", None, None, None, None)]
    s = snapshot(spark, [app(1, 3, "Company Research"), app(2, 4, "Duplicate"), app(3, 4, "Skipped"),
                         app(4, 3, "Company Research", job=20)], [ALICE, given], companies=companies, jobs=jobs)
    targets = spark.createDataFrame([(1,)], "id BIGINT")
    got = {r["id"]: (r["state"], r["contact_id"]) for r in advance.advance_targeted(s, Rules(), targets, 7).collect()}
    assert got == {1: ("Completed", 7), 2: ("Completed", 7)}


def in_order(apps, jobs, companies, contacts, accepting, answers, signals):
    """One row after the other: application -> (stage, state, contact id, mailbox), and the contacts after the run."""
    company_of = {j[0]: j[1] for j in jobs}
    names = {c[0]: (c[1], c[2] or c[1].lower().replace(" ", "") + ".com") for c in companies}
    own = {c[0]: dict(zip(("id", "company", "name", "role", "email"), c, strict=True)) for c in contacts}
    stored_owner = {}
    for c in sorted(own.values(), key=lambda c: c["id"]):
        if c["email"]:
            stored_owner.setdefault(c["email"], c["id"])
    first_mailed = {}
    for c in sorted(own.values(), key=lambda c: c["id"]):
        if c["email"] is not None:
            first_mailed.setdefault(c["company"], c["id"])
    written_to = {a[3] for a in apps if a[5] in ("Completed", "Gmail Draft Creation", "Email Generation")}
    guarded = {co for co, c in first_mailed.items() if c in written_to}
    rank = Rules().role_priority
    companies_met, mailboxes_met, made, found = set(), set(), {}, {}
    out = {}
    next_id = max(own, default=0)
    for a in sorted(apps):
        i, _, job, linked, stage, state = a[:6]
        if state in RUN_TERMINAL or not 3 <= stage <= 11:
            out[i] = (stage, state, linked, None)
            continue
        research, tailor, valid, draft = signals[i]
        co = company_of[job]
        contact = own.get(linked)
        is_open = stage <= 4 and contact is None
        if is_open:
            best = sorted((c for c in own.values() if c["company"] == co and c["id"] not in made.values()), key=lambda c: (
                next((k for k, r in enumerate(rank) if r in c["role"].lower()), len(rank)), c["id"]))
            contact = best[0] if best else None
        name = contact["name"] if contact else "Hiring Manager" if is_open else None
        before = next(c[4] for c in contacts if c[0] == contact["id"]) if contact and contact["id"] not in made.values() else None
        mailbox = before
        if not before and name is not None and stage <= 5:
            answer = answers.get(contact["id"]) if contact else None
            if answer and answer.split("@")[1] in accepting:
                mailbox = answer
            elif names[co][1] in accepting:
                mailbox = name.lower().replace(" ", ".") + "@" + names[co][1]
            else:
                mailbox = None

        def fails():
            if stage <= 3 and not research:
                return 3, "Research Failed"
            if is_open and (co in guarded or co in companies_met or mailbox in mailboxes_met):
                return 4, "Duplicate"
            if stage <= 5 and not mailbox:
                return 5, "No Professional Email" if name else "Failed"
            if stage <= 7 and not tailor:
                return 7, "Failed"
            if stage <= 8 and name is None:
                return 8, "Failed"
            if stage <= 9 and not valid:
                return 9, "Validation Failed"
            if stage <= 10 and not draft:
                return 10, "Draft Failed"
            return None

        stop = fails()
        end = stop[0] if stop else 12
        final = linked
        if is_open and end > 4:
            if contact is None:
                if co not in made:
                    next_id += 1
                    made[co] = next_id
                    own[next_id] = {"id": next_id, "company": co, "name": name, "role": "Engineering Manager", "email": None}
                final = made[co]
            else:
                final = contact["id"]
        shown = mailbox if end > 5 or before else None
        if stage <= 5 and end > 5 and not before:
            holder = stored_owner.get(mailbox, found.get(mailbox))
            if holder is None:
                found[mailbox] = holder = final
                own[final]["email"] = own[final]["email"] or mailbox  # the first one found stays
            final = holder
        elif not (is_open and end > 4):
            shown = own[linked]["email"] if linked in own and not (stage <= 5 and end > 5) and before else (before or None)
        if end == 12 or (stage <= 10 and end > 10):
            companies_met.add(co)
            mailboxes_met.add(mailbox)
        out[i] = (12, "Completed", final, shown) if not stop else (*stop, final, shown)
    return out, {c["id"]: c["email"] for c in own.values()}


@pytest.mark.parametrize("seed", [1])
def test_runs_against_a_loop(spark, tmp_path, seed):
    rng = random.Random(seed)
    companies = [(i, f"Co{i}", rng.choice([None, f"co{i}.com", "shared.com"]), "x", 1) for i in range(1, 9)]
    jobs = [(i, rng.randint(1, 8), "Dev", None, None, f"u{i}", None) for i in range(1, 61)]
    contacts = [(i, rng.randint(1, 6), rng.choice(["Ann Lee", "Bob Ray", "Cid Poe"]), rng.choice(["CTO", "HR", "Clerk"]),
                 rng.choice([None, None, f"p{i}@else.com"])) for i in range(1, 15)]
    apps = [(i, "r", i, rng.choice([None, None, rng.randint(1, 14)]), rng.randint(3, 5), rng.choice(["Company Research", "Contact Research", "Skipped"]),
             None, None, DAY) for i in range(1, 61)]
    signals = {a[0]: tuple(rng.random() < p for p in (.9, .9, .9, .8)) for a in apps}
    accepting = {"co1.com", "co2.com", "co4.com", "shared.com", "other.com"}
    answers = {i: rng.choice(["x@other.com", f"y{i}@other.com", "z@refused.com", f"w{i % 3}@shared.com"]) for i in range(1, 12)}
    s = snapshot(spark, apps, contacts, [(i, *v) for i, v in signals.items()], companies=companies, jobs=jobs)
    s = replace(s, mail_domains=spark.createDataFrame([(d, True) for d in accepting] + [("refused.com", False)], "domain STRING, accepts_mail BOOLEAN"),
                mailboxes=spark.createDataFrame(list(answers.items()), "contact_id BIGINT, answer STRING"))
    want, mailboxes = in_order(apps, jobs, companies, contacts, accepting, answers, signals)
    tables = run.run_tables(s, Rules(), "RUN-1", NOW)
    run.commit(tables, str(tmp_path), "RUN-1")
    after = run.latest(spark, str(tmp_path))
    got = {r["id"]: (r["current_stage"], r["state"], r["contact_id"]) for r in after.applications.collect()}
    assert got == {i: w[:3] for i, w in want.items()}
    assert {r["id"]: r["email"] for r in after.contacts.collect()} == mailboxes
    held = [m for m in mailboxes.values() if m]
    assert len(held) == len(set(held))
    # Of the rows that chose whom to write to, no two wrote to one person.
    drafts = after.emails.where("status = 'draft_created'").join(after.applications.withColumnRenamed("id", "application_id"), "application_id")
    chose = {a[0] for a in apps if a[3] is None}
    people = [r["contact_id"] for r in drafts.collect() if r["application_id"] in chose]
    assert people and len(people) == len(set(people))
    assert after.resumes.count() == sum(w[0] >= 8 and w[1] not in ("Skipped",) for w in want.values())
    # A second run starts from the first one's output and moves nothing.
    again = replace(s, applications=after.applications, contacts=after.contacts, emails=after.emails, resumes=after.resumes)
    second = run.run_tables(again, Rules(), "RUN-2", NOW)
    assert sorted(second.applications.collect()) == sorted(after.applications.collect())
    assert second.history.count() == 0 and second.emails.count() == after.emails.count()


def test_a_run_that_dies_leaves_the_run_before(spark, tmp_path):
    s = snapshot(spark, [app(1, 3, "Company Research")], [ALICE])
    out = str(tmp_path)
    assert run.latest(spark, out) is None
    tables = run.run_tables(s, Rules(), "RUN-1", NOW)
    tables.applications.write.parquet(f"{out}/runs/RUN-1/applications")  # died before its commit
    assert run.latest(spark, out) is None
    run.commit(tables, out, "RUN-1")
    assert run.latest(spark, out).applications.first()["state"] == "Completed"
    tables.contacts.write.parquet(f"{out}/runs/RUN-2/contacts")
    after = run.latest(spark, out)
    assert after.contacts.first()["email"] == "alice.developer@mocktech.com" and after.history.count() == 9
    assert after.emails.first()["status"] == "draft_created" and after.resumes.count() == 1


def test_chains_through_company_and_mailbox(spark, rows):
    schema = "id BIGINT, company_id BIGINT, mailbox STRING, open BOOLEAN"
    rng = random.Random(3)
    for data in ([(i, i // 2, f"m{(i + 1) // 2}", True) for i in range(12)],
                 [(i, rng.randint(1, 9), rng.choice([None, "", f"m{rng.randint(1, 9)}"]), rng.random() < .8) for i in range(80)], []):
        met, want = set(), []
        for i, co, box, is_open in data:
            if not is_open or not ({co, box or None} - {None}) & met:
                want.append((i,))
                met |= {co, box or None} - {None}
        assert rows(advance.contacted_in_order(spark.createDataFrame(data, schema)), "id") == sorted(want, key=repr)


def test_found_mailbox_comes_before_the_guesses(spark, rows):
    contacts = spark.createDataFrame([(i, 1, "Jane Doe", "CTO", None) for i in range(1, 6)], CONTACT)
    companies = spark.createDataFrame([(1, "Mock", "mocktech.com", "x", 1)], COMPANY)
    mx = spark.createDataFrame([("mocktech.com", True), ("else.org", True), ("dead.org", False)], "domain STRING, accepts_mail BOOLEAN")
    answers = spark.createDataFrame([(1, " jd@else.org"), (2, "jd@dead.org"), (3, "nothing"), (4, None)], "contact_id BIGINT, answer STRING")
    guess = "jane.doe@mocktech.com"
    got = outreach.first_valid_mailbox(contacts, companies, mx, answers)
    assert rows(got, "id", "mailbox") == [(1, "jd@else.org"), (2, guess), (3, guess), (4, guess), (5, guess)]


def test_outcomes_from_cache_and_answers(spark, rows):
    companies = spark.createDataFrame([(i, f"Co{i}", None, None, 1) for i in range(1, 5)], COMPANY)
    entries = spark.createDataFrame([("company_research_co1", "{}x", DAY), ("company_research_co2", "old", datetime(2023, 1, 1))],
                                    "key STRING, value STRING, expires_at TIMESTAMP_NTZ")
    good = json.dumps({"business_model": "b", "funding": "f", "tech_stack": ["a"], "culture": "c", "leadership": []})
    answers = spark.createDataFrame([(1, "broken"), (2, f"```json\n{good}\n```"), (3, good[:-1])], "company_id BIGINT, raw STRING")
    found = outcomes.research(companies, entries, answers, str(DAY))
    assert rows(found) == [(1, True, "cache"), (2, True, "answer"), (3, False, "none"), (4, False, "none")]
    raw = [(1, '{"role_match": 1, "tech_stack": "0.5", "salary": 0, "company_quality": 1.0, "growth": 1e0, "confidence": 0.25, "reasoning": "r"}',
            "x", '{"subject": "s", "body_html": "b"}', '{"is_valid": false, "errors": ["e"]}'), (2, None, None, None, "no")]
    df = spark.createDataFrame(raw, "id INT, score_raw STRING, tailor_raw STRING, message_raw STRING, validation_raw STRING")
    got = outcomes.with_outcomes(df)
    assert rows(got, "id", "role_match", "tech_stack", "growth", "subject", "valid_ok", "reasoning") == [
        (1, 1.0, 0.5, 1.0, "s", False, "base resume kept"), (2, None, None, None, None, True, "base resume kept")]


@pytest.mark.parametrize("limit, sent_today", [(3, 2), (50, 0), (1, 0)])
def test_quota_against_loop(spark, limit, sent_today):
    rng = random.Random(limit * 10 + sent_today)
    apps = [app(i, rng.choice([7, 9, 10, 10]), "Resume Tailoring", 6) for i in range(1, 31)]
    signals = [(a[0], True, rng.random() < .8, True, rng.random() < .7) for a in apps]
    stale = datetime(2023, 1, 1)
    emails = [(a[0], a[0], "s", "b", None, "generated", DAY if a[0] % 2 else stale) for a in apps]
    emails += [(1000 + i, 900 + i, "s", "b", "d", "draft_created", DAY) for i in range(sent_today)]
    resumes = [(a[0], a[0], "p", "p") for a in apps]
    known = (6, 1, "Bob Known", "CTO", "bob@mocktech.com")
    s = snapshot(spark, apps, [known], signals, emails, resumes)
    flags, today, admitted = {x[0]: x for x in signals}, sent_today, {}
    open_run = True
    for a in apps:
        if open_run and today >= limit and a[4] == 10:
            open_run = False
        admitted[a[0]] = open_run
        drafts = (a[4] > 7 or flags[a[0]][2]) and flags[a[0]][4]
        if open_run and drafts and (a[4] <= 8 or a[0] % 2):
            today += 1
    got = advance.quota_admission(s, Rules(), "2024-01-02 12:00:00", limit)
    assert {r["id"]: r["admitted"] for r in got.collect()} == admitted
    moved = advance.advance(s, Rules(), daily_limit=limit, as_of="2024-01-02 12:00:00")
    for r in moved.collect():
        if not admitted[r["id"]]:
            assert (r["current_stage"], r["state"]) == (r["old_stage"], r["old_state"])
        else:
            assert (r["current_stage"], r["state"]) != (r["old_stage"], r["old_state"])


def test_retry_and_override(spark, rows):
    apps = spark.createDataFrame([app(1, 3, "Research Failed"), app(2, 10, "Draft Failed"), app(3, 9, "Validation Failed"),
                                  app(4, 5, "Failed"), app(5, 5, "Duplicate")], APPLICATION)
    assert rows(advance.retry_reset(apps), "id", "current_stage", "state") == [
        (1, 3, "Company Research"), (2, 10, "Gmail Draft Creation"), (3, 7, "Resume Tailoring"),
        (4, 7, "Resume Tailoring"), (5, 5, "Duplicate")]
    fixes = spark.createDataFrame([(1, 1, "Skipped"), (1, 2, "Manual Skip")], "application_id BIGINT, seq INT, state STRING")
    got = advance.override_states(apps, fixes, NOW)
    assert rows(got, "id", "current_stage", "state")[0] == (1, 3, "Manual Skip")
    assert got.where("id = 1").first()["updated_at"] == datetime.fromisoformat(NOW)
    assert got.where("id = 2").first()["updated_at"] == DAY


def test_responses_are_taken_strictly(spark):
    row = T.StructType([T.StructField("n", T.StringType(), False)])
    schema = T.StructType([T.StructField("k", T.IntegerType(), False), T.StructField("t", T.StringType(), True),
                           T.StructField("r", T.ArrayType(row), False)])
    good = ['{"k": 1, "t": "x", "r": []}', '{"k": "7", "t": null, "r": []}', '{"k": 1, "t": "a", "r": [{"n": "b"}]}',
            '```json\n{"k": 1, "t": "x", "r": []}\n```']
    bad = ['{"k": 1, "t": "x", "r": []} more', '{"k": 1, "t": "x", "r": []}{"k": 2}', '{"k": 1, "t": "x", "r": []}, {"k": 2}',
           "{'k': 1, 't': 'x', 'r': []}", '{"k": 1, "t": 5, "r": []}', '{"k": 1, "t": true, "r": []}',
           '{"k": 1, "t": {"a": 1}, "r": []}', '{"k": 1, "t": ["x"], "r": []}', '{"k": 1, "t": "a", "r": [{"n": 5}]}', "[1]", "x", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(good + bad)], "i INT, raw STRING")
    got = {r["i"]: r["accepted"] for r in responses.parse(rows, "raw", schema).collect()}
    assert [got[i] for i in range(len(good + bad))] == [True] * len(good) + [False] * len(bad)


def test_a_write_replaces_value_and_expiry(spark, rows):
    schema = "key STRING, version BIGINT, value STRING, created_at TIMESTAMP_NTZ, "
    stored = spark.createDataFrame([("a", 1, "x", DAY, DAY + timedelta(days=9)), ("b", 2, "x", DAY, DAY)], schema + "expires_at TIMESTAMP_NTZ")
    writes = spark.createDataFrame([("a", 3, "short", DAY + timedelta(hours=1), 5), ("c", 4, "none", DAY, None), ("c", 5, "default", DAY, None),
                                    ("b", 6, "older", DAY - timedelta(days=1), 10**6)], schema + "ttl_seconds BIGINT")
    got = cache.write(stored, writes, Rules(cache_ttl_seconds=60))
    assert rows(got, "key", "value", "expires_at") == [
        ("a", "short", DAY + timedelta(hours=1, seconds=5)), ("b", "x", DAY), ("c", "default", DAY + timedelta(seconds=60))]


def test_lifetimes_in_seconds(spark):
    rows = spark.createDataFrame([(90,), (0,), (-5,), (90_000,)], "s INT").select(
        "s", cache.expiry_after(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "s").alias("e"))
    assert {r["s"]: str(r["e"]) for r in rows.collect()} == {
        90: "2024-01-01 00:01:30", 0: "2024-01-01 00:00:00", -5: "2023-12-31 23:59:55", 90_000: "2024-01-02 01:00:00"}
