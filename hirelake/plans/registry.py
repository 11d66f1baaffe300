"""Registered queries: each operator over the fixture views of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.functions import display, mail, text, web
from hirelake.operators import (
    audit,
    cache,
    export,
    fetchlog,
    filtering,
    generate,
    hygiene,
    messages,
    outreach,
    pages,
    reporting,
    resolution,
    responses,
)
from hirelake.plans import advance, discovery, outcomes, run
from hirelake.rules import FIXTURE_RULES as RULES
from hirelake.session import configure, staged, staging_path
from hirelake.sources import scans
from hirelake.sources.schemas import RESPONSES
from hirelake.sources.views import EVENTS_AS_OF, ORDERS_AS_OF, SLICES, arrivals, base, view, view_stream
from hirelake.streaming import entries
from hirelake.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

K_RESPONSE = T.StructType([T.StructField("k", T.IntegerType(), nullable=False)])
CARVE_EXCLUSIONS = ("00000007", "customer#00000001", "Labs")
OWN_HOSTS = ["engine.example.net"]
BLOCK_HEAVY = ("spam-farm", "blog.")
ADVERTISERS = ("casino", "pills")
EVIDENCE_CHARS = 2000
EXPORT_SLICES = ("1994-07-01 00:00:00", "1997-01-01 00:00:00", "2010-01-01 00:00:00")
# Repeats of a delivery are known for so long.
DEDUP_HOURS = 72
EXPORT_DAY = "1996-01-01 00:00:00"
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
# What a correction makes of an application, by kind of event; views correct nothing.
OVERRIDES = {"purchase": "Manual Skip", "signup": "Skipped", "error": "Failed", "click": "Timeout"}
NOTE = "Hello {name}, the {role} opening at {company} fits my work on {stack}."


class Tables:
    """Attribute access to the views: ``t.jobs`` is ``v_jobs``; each view is built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        built = view(self.spark, self.sf_dir, f"v_{name}")
        setattr(self, name, built)
        return built

    def base(self, name: str) -> DataFrame:
        return base(self.spark, self.sf_dir, name)


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(configure(spark), sf_dir))

    registered.__name__ = fn.__name__
    QUERIES[fn.__name__] = registered
    return fn


def _time(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    """Integer columns that may be null, as text: engines disagree on how such columns leave them."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# --- scans -------------------------------------------------------------------------------------
@query
def scan_entities(t):
    return _shown(t.applications.withColumn("updated_at", _time("updated_at")), "contact_id")


@query
def log_tail(t):
    return scans.log_tail(t.history, ["timestamp", "id"]).select(
        "id", "application_id", F.col("stage").cast("int"), "state", "run_id", F.trim("notes").alias("line"))


@query
def log_scan(t):
    """A log file with broken lines, written as text and scanned."""
    path = staging_path(t.spark, "log")
    t.log_lines.orderBy("line_number").select("line").write.text(path)
    rows, rejects = scans.scan_log(t.spark.read.text(path))
    shown = rows.select(F.lit("row").alias("channel"), "level", "message", "run_id", "stage", "duration_seconds",
                        F.col("retries").cast("string").alias("retries"), F.lit(None).cast("string").alias("line"))
    lost = rejects.select(F.lit("reject").alias("channel"), "line")
    return shown.unionByName(lost, allowMissingColumns=True)


@query
def evolve_emails(t):
    emails = t.emails
    legacy = emails.where(F.col("status") == "generated")
    current = emails.where(F.col("status") == "draft_created").withColumn("scheduled_at", F.col("created_at"))
    merged = scans.add_missing(scans.evolve(legacy, current), "scheduled_at", "timestamp_ntz")
    return merged.select("id", "application_id", "status", _time("scheduled_at"))


@query
def integrity_audit(t):
    return audit.integrity({
        "runs": t.runs, "companies": t.companies, "jobs": t.jobs, "contacts": t.contacts,
        "applications": t.applications, "emails": t.emails,
        "resume_versions": t.resume_versions, "history": t.history, "cache_entries": t.cache})


# --- filters -----------------------------------------------------------------------------------
@query
def filter_company_exclusion(t):
    return filtering.keep_companies(t.companies, RULES).select("id", "name")


@query
def filter_title_keyword(t):
    return filtering.keep_titles(t.jobs, RULES).select("id", "title")


@query
def filter_experience(t):
    return filtering.keep_experience(t.jobs, RULES).select("id", "experience_years_required")


@query
def filter_cascade(t):
    return filtering.screen(t.jobs, t.companies, RULES)


@query
def refilter_existing(t):
    columns = ["id", "company_id", "title", "experience_years_required"]
    openings = t.jobs.select(columns).unionByName(t.postings.select(columns))
    return _shown(filtering.enter_screening(openings, t.companies, t.applications, RULES), "application_id")


@query
def resume_selection(t):
    return filtering.unfinished(t.applications).select("id", F.col("current_stage").cast("int"), "state")


@query
def drafts_today(t):
    return reporting.drafts_on_day(t.emails, ORDERS_AS_OF)


@query
def domain_denylist(t):
    return filtering.drop_denied(t.base("pages"), _denied(t), BLOCK_HEAVY).select(
        "page_id", "domain", "is_block_heavy")


@query
def exclusion_carveout(t):
    return filtering.carve_out(t.companies, CARVE_EXCLUSIONS).select(
        "id", F.array_join("kept", ",").alias("kept"))


@query
def normalize_url(t):
    return filtering.normalize_urls(t.jobs).select("id", "url")


# --- joins and resolution ------------------------------------------------------------------------
@query
def active_applications(t):
    return reporting.active_list(t.applications, t.jobs, t.companies, ORDERS_AS_OF)


@query
def application_list(t):
    return reporting.full_list(t.applications, t.jobs, t.companies, t.contacts)


@query
def company_list(t):
    return reporting.company_list(t.companies)


@query
def contact_list(t):
    return reporting.contact_list(t.contacts, t.companies)


@query
def job_list(t):
    return reporting.job_list(t.jobs, t.companies)


@query
def application_details(t):
    return reporting.details(t.applications, t.jobs, t.companies, t.contacts, t.emails,
                             t.resume_versions, t.history)


@query
def company_upsert(t):
    return resolution.upsert_companies(t.companies, t.found_companies) \
        .select("id", "name", "ordinal", "is_new", "domain")


@query
def job_upsert(t):
    stored = t.jobs.where(F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    found = t.jobs.where(F.col("created_at") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return resolution.upsert_jobs(stored, found.withColumnRenamed("id", "ordinal")) \
        .select("id", "url", "ordinal", "is_new", "company_id", "title")


@query
def contact_upsert(t):
    return resolution.upsert_contacts(t.contacts, t.found_contacts) \
        .select("id", "company_id", "name", "ordinal", "is_new", "role")


@query
def entity_match(t):
    return _shown(resolution.match_companies(t.targets, t.companies), "company_id")


@query
def duplicate_guard(t):
    return outreach.duplicate_applications(t.applications, t.jobs, t.contacts).select("id", "company_id")


@query
def completed_semi(t):
    return reporting.completed_applications(t.applications, t.emails).select("id", "state")


@query
def email_conflict_relink(t):
    found = outreach.first_valid_mailbox(t.contacts.where(~text.filled("email")), t.companies, t.mx)
    shared = t.contacts.where(text.filled("email"))
    both = found.select(F.col("id").alias("contact_id"), F.col("mailbox").alias("email")).unionByName(
        shared.select(F.col("id").alias("contact_id"), "email"))
    return outreach.relink_conflicts(both, t.contacts)


@query
def mail_domain_join(t):
    return outreach.mail_capable(t.contacts, t.mx).select("id", "email", "domain")


@query
def export_pending(t):
    done = t.emails.where(F.col("gmail_draft_id").isNotNull()).select("application_id")
    return export.pending(t.applications, done).select("id", "state")


# --- aggregates --------------------------------------------------------------------------------
@query
def status_summary_web(t):
    return reporting.web_summary(t.applications, t.jobs, t.companies, t.emails)


@query
def status_summary_cli(t):
    return reporting.cli_summary(t.applications)


@query
def active_runs(t):
    return reporting.running_runs(t.runs)


@query
def domain_stats(t):
    return fetchlog.domain_totals(t.fetch_log)


@query
def domain_stats_merge(t):
    log = t.fetch_log
    wins = log.where("ok").groupBy("domain").agg(F.count("*").alias("successes"))
    losses = log.where(~F.col("ok")).groupBy("domain").agg(F.count("*").alias("failures"))
    return fetchlog.merge_totals(wins, losses)


@query
def domain_blacklist(t):
    return fetchlog.blacklist(fetchlog.domain_totals(t.fetch_log), RULES)


@query
def domain_breaker(t):
    return fetchlog.with_breaker(t.fetch_log, RULES).select("id", "domain", "ok", "disabled")


@query
def next_run_id(t):
    return reporting.next_run_ids(t.runs)


@query
def weighted_score(t):
    return reporting.weighted_scores(t.scores, RULES).select(
        "application_id", F.round("score", 6).alias("score"), "passes")


@query
def stage_funnel(t):
    return _shown(reporting.stage_funnel(t.applications), "current_stage")


# --- per-group picks, top-k, order ------------------------------------------------------------------
@query
def latest_email(t):
    return reporting.latest_per_application(
        t.emails.select("id", "application_id", "subject", "gmail_draft_id", "status"))


@query
def latest_resume(t):
    return reporting.latest_per_application(t.resume_versions.select("id", "application_id", "path"))


@query
def best_contact(t):
    return outreach.best_contacts(t.contacts, RULES).select("company_id", "id", "role", "rank")


@query
def first_valid_email(t):
    return outreach.first_valid_mailbox(t.contacts, t.companies, t.mx, _mailboxes(t)).select("id", "mailbox")


@query
def first_seen_dedup(t):
    return resolution.first_seen(t.found_companies, ["name"], "ordinal")


@query
def recent_applications(t):
    return reporting.recent(t.applications, t.jobs, t.companies)


@query
def topn_hits(t):
    return pages.top_hits(t.hits, _denied(t), 3).select("query_id", "rank", "pos", "target", "domain")


def _denied(t):
    """Exact domains to skip, as a fetch log would yield them: here the advertising hosts."""
    located = t.base("pages").select(web.url_domain("url").alias("domain"))
    return located.where(text.contains_any("domain", ADVERTISERS)).distinct()


@query
def draft_quota(t):
    return advance.quota_admission(_snapshot(t), RULES, ORDERS_AS_OF)


@query
def history_timeline(t):
    return reporting.timeline(t.history).withColumn("stage", F.col("stage").cast("int")).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# --- set operations and arrays -------------------------------------------------------------------
@query
def hits_union(t):
    names = pages.top_hits(t.hits, _denied(t), 2).select("query_id", "rank", "target")
    others = pages.clean_ru_hits(t.ru_hits, OWN_HOSTS).select("query_id", F.col("pos").cast("int").alias("rank"), "target")
    return pages.union_hits(names, others)


@query
def keywords_text(t):
    words = F.split("added_words", " ")
    return t.keywords.select("id", messages.keywords_text(words, "software development").alias("skills"))


# --- text and scalar columns ---------------------------------------------------------------------
@query
def email_syntax(t):
    return t.contacts.select("id", mail.mailbox_ok("email").alias("sound"))


@query
def email_verdict(t):
    return outreach.mail_verdicts(t.contacts, t.mx).select("id", "verdict")


@query
def clean_domain(t):
    return t.base("pages").select("page_id", web.bare_domain("url").alias("domain"))


@query
def email_candidates(t):
    guessed = outreach.with_guesses(t.contacts, t.companies)
    return guessed.select("id", F.array_join("guesses", ",").alias("guesses"))


@query
def default_domain(t):
    return t.companies.select("id", mail.company_domain("domain", "name").alias("domain"))


@query
def url_domain(t):
    return t.base("pages").select("page_id", web.url_domain("url").alias("domain"))


@query
def slug_key(t):
    return t.companies.select("id", messages.speculative_key(
        F.concat("name", F.lit(" "), "industry")).alias("key"))


@query
def content_key(t):
    return t.base("documents").select("doc_id", messages.pasted_key("source", "text").alias("key"))


@query
def relative_age(t):
    return t.applications.select("id", display.age_text("updated_at", ORDERS_AS_OF).alias("age"))


@query
def score_round(t):
    score = F.col("score") / 3
    return t.applications.select("id", display.score_or_null(score).alias("listed"),
                                 display.score_shown(score).alias("detailed"))


@query
def body_preview(t):
    return t.base("documents").select("doc_id", display.body_preview("text").alias("preview"))


@query
def mailbox_name(t):
    return t.contacts.select("id", mail.name_from_mailbox("email").alias("name"))


# --- pages -----------------------------------------------------------------------------------------
@query
def page_text(t):
    return pages.page_text(t.pages).select("page_id", "text")


@query
def page_text_parsed(t):
    return pages.page_text_parsed(t.pages)


@query
def chunk_assembly(t):
    hits = pages.top_hits(t.hits, _denied(t), 3)
    listed = hits.select("query_id", "rank", F.col("target").alias("url"), F.col("domain").alias("title"))
    return pages.evidence(listed, t.pages.select("url", "html"), EVIDENCE_CHARS)


@query
def clean_redirect(t):
    return pages.clean_hits(t.hits).select("pos", "target")


@query
def clean_redirect_ru(t):
    return pages.clean_ru_hits(t.ru_hits, OWN_HOSTS).select("query_id", "target", "pos")


@query
def extract_links(t):
    return pages.page_links(t.pages)


@query
def search_results(t):
    return pages.search_results(t.queries, t.first_pages, t.second_pages, _denied(t), OWN_HOSTS, 3)


# --- responses ---------------------------------------------------------------------------------------
@query
def fence_strip(t):
    return t.responses.select("id", responses.unfenced("raw").alias("body"))


@query
def response_parse(t):
    return responses.accepted_rows(responses.parse(t.responses, "raw", K_RESPONSE)).select("id", "k")


@query
def response_rejects(t):
    return responses.rejected_rows(responses.parse(t.responses, "raw", K_RESPONSE)).select("id", "raw")


@query
def json_or_raw(t):
    return responses.json_or_text(t.responses, "raw").select(
        "id", F.try_variant_get("json", "$.k", "string").alias("k"), "plain")


@query
def response_explode(t):
    parsed = responses.parse(t.job_responses, "raw", RESPONSES["job_list"])
    return responses.explode_rows(parsed, "jobs", ["company_id"]).select(
        "company_id", "pos", "title", text.blank_to_null("url").alias("url"), "location",
        "experience_years")


@query
def template_render(t):
    c = t.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "industry")
    joined = t.contacts.join(c, "company_id")
    return joined.select("id", messages.render(NOTE, {
        "name": F.col("name"), "role": F.lower("role"), "company": F.col("company"),
        "stack": text.or_text(F.when(text.filled("email"), F.col("industry")), "modern tools"),
    }).alias("message"))


@query
def message_fallback(t):
    parsed = responses.parse(t.responses, "raw", K_RESPONSE)
    return messages.or_fallback(parsed, {"k": F.length("raw")}).select("id", "accepted", "k")


@query
def signature_inject(t):
    return t.messages.select("id", messages.sign("body", RULES).alias("body"))


@query
def placeholder_check(t):
    return messages.check_messages(t.messages, "body").select(
        "id", "is_valid", F.array_join("errors", ", ").alias("errors"))


@query
def unsupported_keywords(t):
    words = messages.unsupported(F.split("added_words", " "), F.split("base_words", " "))
    return t.keywords.select("id", F.array_join(words, ",").alias("unsupported"))


@query
def structured_generate(t):
    provider = generate.OfflineProvider(K_RESPONSE)
    asked = t.history.select("id", F.concat("state", F.lit(" of "), "run_id").alias("prompt"))
    out = generate.structured_generate(asked, "prompt", K_RESPONSE, provider)
    return out.select("id", "accepted", "response.k")


# --- state machine -----------------------------------------------------------------------------------
RUN_ID = "RUN-19980615-001"
GATE_BOUNDS = (2, 5, 7, 10, 12)


def _mailboxes(t) -> DataFrame:
    return outcomes.mailboxes(t.contacts, t.companies, cache.upsert(t.run_cache), t.mailbox_answers, ORDERS_AS_OF)


def _research(t) -> DataFrame:
    return outcomes.research(t.companies, cache.upsert(t.run_cache), t.research_answers, ORDERS_AS_OF)


def _snapshot(t) -> advance.Snapshot:
    return advance.Snapshot(
        t.applications, t.jobs, t.companies, t.contacts, t.mx, None, t.signals, t.emails, t.resume_versions,
        _research(t), _mailboxes(t), t.answers)


@query
def research_outcomes(t):
    return _research(t)


@query
def research_cached(t):
    """The run's cache after it: answers stored for the rules' lifetime."""
    stored = cache.upsert(t.run_cache).withColumn("created_at", F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"))
    new = outcomes.research_to_store(_research(t), t.companies, t.research_answers, ORDERS_AS_OF)
    return cache.write(stored, new, RULES).select("key", "value", _time("expires_at"))


@query
def application_advance(t):
    out = advance.advance(_snapshot(t), RULES)
    return _shown(out.withColumn("score", F.round("score", 6)), "contact_id")


def _run_rows(s: advance.Snapshot, texts: bool = False) -> DataFrame:
    return staged(advance.with_contacts(advance.judged(s, RULES, texts=texts), s.contacts), "run-rows")


@query
def advance_contacts(t):
    s = _snapshot(t)
    rows = _run_rows(s)
    return run.contacts_after(s, rows).select("id", "company_id", "name", "role", "email", "origin")


@query
def advance_emails(t):
    s = _snapshot(t)
    rows = _run_rows(s, texts=True)
    return run.emails_after(s, rows, RULES, ORDERS_AS_OF).select(
        "id", "application_id", "subject", "body", "gmail_draft_id", "status", _time("created_at"), "origin")


@query
def advance_resumes(t):
    s = _snapshot(t)
    rows = _run_rows(s, texts=True)
    return run.resumes_after(s, rows, ORDERS_AS_OF).select(
        "id", "application_id", "parent_resume", "path", _time("created_at"), F.array_join("keywords_added", ",").alias("keywords"),
        "reasoning", "origin")


@query
def history_emit(t):
    return run.history_of(_snapshot(t), RULES, RUN_ID, ORDERS_AS_OF).withColumn("timestamp", _time("timestamp"))


@query
def retry_log(t):
    return advance.retry_history(t.applications, RUN_ID, ORDERS_AS_OF).withColumn("timestamp", _time("timestamp"))


@query
def screening_log(t):
    columns = ["id", "company_id", "title", "experience_years_required"]
    openings = t.jobs.select(columns).unionByName(t.postings.select(columns))
    entered = filtering.enter_screening(openings, t.companies, t.applications, RULES)
    return advance.screening_history(entered, RUN_ID, ORDERS_AS_OF).withColumn("timestamp", _time("timestamp"))


@query
def stage_gate(t):
    return advance.advance_to(_snapshot(t), RULES, GATE_BOUNDS)


@query
def retry_reset(t):
    return advance.retry_reset(t.applications)


@query
def state_override(t):
    states = F.create_map(*[F.lit(x) for pair in OVERRIDES.items() for x in pair])
    fixes = t.history.select(
        "application_id", F.col("id").alias("seq"), F.try_element_at(states, F.col("state")).alias("state"))
    return advance.override_states(t.applications, fixes, ORDERS_AS_OF).select(
        "id", F.col("current_stage").cast("int"), "state", _time("updated_at"))


@query
def speculative_jobs(t):
    screened = filtering.keep_experience(filtering.keep_titles(t.jobs, RULES), RULES)
    companies = t.companies.select("id", "name").unionByName(t.prospects)
    return resolution.speculative_jobs(companies, screened, RULES)


@query
def placeholder_contacts(t):
    return resolution.placeholder_contacts(t.companies, t.contacts)


@query
def discovery_run(t):
    run = discovery.discover(t.companies, t.jobs, t.applications, t.found_companies, t.job_responses, RULES)
    jobs = run.jobs.select(F.col("id").alias("job_id"), "company_id", "title", "url")
    return run.entered.drop("application_id").join(jobs, "job_id")


@query
def targeted_advance(t):
    targets = t.companies.where(F.col("industry") == "MACHINERY").select("id")
    out = advance.advance_targeted(_snapshot(t), RULES, targets, contact_id=4)
    return _shown(out.withColumn("score", F.round("score", 6)), "contact_id")


# --- cache -------------------------------------------------------------------------------------------
def _entries(t):
    """The first days' writes as stored entries, then the others."""
    day = F.lit(SLICES[0]).cast("timestamp_ntz")
    none = t.spark.createDataFrame([], "key STRING, version BIGINT, value STRING, created_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ")
    stored = cache.write(none, t.cache.where(F.col("created_at") < day), RULES)
    return cache.write(stored, t.cache.where(F.col("created_at") >= day), RULES)


def _requests(t):
    return t.history.select(F.col("id").alias("request_id"), F.concat(
        "state", F.lit(":"), (F.col("application_id") + F.col("stage")).cast("string")).alias("key"))


@query
def cache_lookup(t):
    return cache.lookup(_requests(t), _entries(t), EVENTS_AS_OF).select("request_id", "key", "hit", "value")


@query
def cache_upsert(t):
    return _entries(t).select("key", "version", "value", _time("expires_at"))


@query
def cache_clear_expired(t):
    return cache.expired_count(_entries(t), EVENTS_AS_OF)


@query
def cache_miss_plan(t):
    made = cache.compute_missing(
        _requests(t), _entries(t), EVENTS_AS_OF,
        lambda missing: missing.withColumn("value", F.concat(F.lit("made:"), "key")))
    return made


# --- hygiene and export ------------------------------------------------------------------------------
@query
def clean_contacts(t):
    return hygiene.clean_contacts(t.contacts, t.mx).select("id", "email", "cleared")


@query
def clean_applications(t):
    cleaned = hygiene.clean_contacts(t.contacts, t.mx)
    return hygiene.clean_applications(t.applications, cleaned).select("id", "state", "changed")


@query
def clean_summary(t):
    cleaned = hygiene.clean_contacts(t.contacts, t.mx)
    return hygiene.clean_summary(cleaned, hygiene.clean_applications(t.applications, cleaned))


@query
def export_record(t):
    jobs = t.jobs.select("id", "company_id", "title", F.lit(None).cast("string").alias("location"),
                         F.col("salary_lpa").cast("string").alias("salary"))
    return export.records(t.applications, jobs, t.companies, t.contacts, t.emails)


def _export_tables(t):
    jobs = t.jobs.select("id", "company_id", "title", F.lit(None).cast("string").alias("location"),
                         F.col("salary_lpa").cast("string").alias("salary"))
    return jobs, t.companies, t.contacts, t.emails


@query
def export_incremental(t):
    """Two passes over one folder, the second with later applications: what the files then hold."""
    out, tables = staging_path(t.spark, "exports"), _export_tables(t)
    early = t.applications.where(F.col("updated_at") < F.lit(EXPORT_DAY).cast("timestamp_ntz"))
    export.export(early, *tables, out, "a")
    export.export(t.applications, *tables, out, "b")
    export.export(t.applications, *tables, out, "c")  # nothing new
    passes = export.commits(t.spark, out).select("pass", "new", "total")
    read = [t.spark.read.json(f"{out}/export_{stamp}.json").agg(
        F.count("*").alias("records"), F.min("application_id").alias("first"), F.count_if(F.col("contact_email") != "N/A").alias("with_mailbox"))
        .withColumn("pass", F.lit(i).cast("bigint")) for i, stamp in enumerate("ab")]
    latest = export.read_latest(t.spark, out).agg(F.count("*").alias("cumulative"))
    return passes.join(read[0].unionByName(read[1]), "pass").withColumn("cumulative", latest.scalar())


# --- batch twins of the streams --------------------------------------------------------------------------
@query
def current_state(t):
    newest = t.history.groupBy("application_id").agg(
        F.max_by(F.struct("state", "stage"), F.struct("timestamp", "id")).alias("s"))
    return newest.select("application_id", "s.state", F.col("s.stage").cast("int").alias("stage"))


@query
def transition_counts(t):
    counts = t.history.groupBy(F.window("timestamp", "1 hour").alias("w"), "state").agg(
        F.count("*").alias("transitions"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                         "state", "transitions")


# --- streams, run over everything available --------------------------------------------------------------
def _run(t, stream: DataFrame, mode: str) -> DataFrame:
    path = staging_path(t.spark, "stream")
    return streams.run_available(stream, f"{path}/out", f"{path}/checkpoint", mode)


def _run_slices(t, name: str, job: Callable[[DataFrame], DataFrame], mode: str = "append",
                state_store: str | None = None, deliveries: str = "v_arrivals") -> DataFrame:
    """Feed the events as they arrive, some late: each slice is a run of its own over the same checkpoint."""
    path = staging_path(t.spark, "stream")
    for part in arrivals(t.spark, t.sf_dir, deliveries):
        part.write.mode("append").parquet(f"{path}/source")
        stream = job(view_stream(t.spark, t.sf_dir, name, "events", f"{path}/source"))
        written = streams.run_available(stream, f"{path}/out", f"{path}/checkpoint", mode, state_store=state_store)
    return written


@query
def stream_current_state(t):
    history = view_stream(t.spark, t.sf_dir, "v_history", "events")
    return streams.newest(_run(t, streams.current_state(history), "update"), ["application_id"]).select(
        "application_id", "state", F.col("stage").cast("int"))


@query
def stream_transition_counts(t):
    history = view_stream(t.spark, t.sf_dir, "v_history", "events")
    written = _run(t, streams.transition_counts(history), "update")
    return streams.newest(written, ["window_start", "state"]).withColumn(
        "window_start", _time("window_start"))


@query
def stream_dedup(t):
    """Deliveries of transitions without the repeats of the last days; one repeated later than that shows up again."""
    kept = _run_slices(t, "v_history", lambda history: streams.first_seen(
        history, ["id"], "timestamp", f"{DEDUP_HOURS} hours").select("id"), deliveries="v_deliveries")
    return kept.groupBy("id").agg(F.count("*").alias("deliveries"))


@query
def stream_export(t):
    """Applications as they are delivered, some twice, exported once each."""
    path, tables = staging_path(t.spark, "stream-export"), _export_tables(t)
    deliveries, start = view(t.spark, t.sf_dir, "v_application_deliveries"), None
    for end in EXPORT_SLICES:
        own = F.col("arrival") < F.lit(end).cast("timestamp_ntz")
        if start is not None:
            own &= F.col("arrival") >= F.lit(start).cast("timestamp_ntz")
        deliveries.where(own).drop("arrival").write.mode("append").parquet(f"{path}/source")
        arrived = view_stream(t.spark, t.sf_dir, "v_applications", "orders", f"{path}/source")
        streams.export_new(arrived, tables, f"{path}/out", f"{path}/checkpoint", "3650 days")
        start = end
    written = t.spark.read.json(f"{path}/out")
    return written.groupBy("application_state").agg(
        F.count("*").alias("exported"), F.countDistinct("application_id").alias("applications"), F.max("company_name").alias("last_company"))


@query
def stream_breaker(t):
    log = view_stream(t.spark, t.sf_dir, "v_fetch_log", "events")
    written = _run(t, streams.breaker(log, RULES), "update")
    return streams.newest(written, ["run_day", "domain"]).withColumn("run_day", F.col("run_day").cast("string"))


@query
def stream_ttl(t):
    closed = _run_slices(t, "v_cache", lambda writes: entries.cache_lifetimes(writes, RULES), state_store=entries.STATE_STORE)
    return closed.select("key", F.date_format("first_write", MICROS).alias("first_write"),
                         F.date_format("expired_at", MICROS).alias("expired_at"), "value", "writes")
