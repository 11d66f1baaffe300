"""Whole-table state machine: advance every application in one run.

Each external step (research, tailoring, validation, drafting) arrives as an outcome column; each
gate is a column; the first gate that fails, from the row's own stage on, fixes the outcome. Rows
are judged once, against the input snapshot, and the judgement is written to the shared folder: every bound on the
stages and every table a run produces starts from it. Only what one row does to the rows behind it (writing to
a company or a mailbox first) is then settled between the few rows it concerns, as sets. Finished rows take
part in no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.mail import company_domain, first_sound_mailbox, mail_domain, mailbox_ok
from hirelake.functions.text import filled, strip
from hirelake.operators.filtering import enter_screening
from hirelake.operators.keys import dense_ids, last_per, lookup
from hirelake.operators.outreach import (
    guarded_companies,
    mailbox_owners,
    role_rank,
    with_mail_flag,
)
from hirelake.operators.reporting import drafts_on_day, weighted_scores
from hirelake.plans.outcomes import with_outcomes
from hirelake.rules import (
    CONTACTED,
    DONE_STAGE,
    FIRST_STAGE,
    LAST_STAGE,
    PLACEHOLDER_NAME,
    PLACEHOLDER_ROLE,
    REFILTER_CLOSED,
    RETRY_DEFAULT_STAGE,
    RETRY_STAGE,
    RETRYABLE,
    RUN_TERMINAL,
    STATE_ON_ENTRY,
    Rules,
)
from hirelake.session import staged

CONTACT = "struct<id: bigint, name: string, role: string, email: string>"


@dataclass(frozen=True)
class Snapshot:
    """Input tables of one run.

    ``signals`` holds the steps' outcomes per application and ``scores`` the components of their scores. Where ``answers``
    (application_id and raw texts) are given, all but the draft's outcome come from them
    (:func:`hirelake.plans.outcomes.with_outcomes`); where ``research`` (company_id, research_ok) is given, that step's comes
    from there. ``mailboxes`` (contact_id, answer) are addresses found for contacts.
    """

    applications: DataFrame
    jobs: DataFrame
    companies: DataFrame
    contacts: DataFrame
    mail_domains: DataFrame
    scores: DataFrame | None
    signals: DataFrame
    emails: DataFrame
    resumes: DataFrame
    research: DataFrame | None = None
    mailboxes: DataFrame | None = None
    answers: DataFrame | None = None


def movable(closed: Sequence[str] = RUN_TERMINAL) -> Column:
    """Rows a run touches: not in a closed state, at a stage with work to do."""
    return ~F.col("state").isin(*closed) & F.col("current_stage").between(FIRST_STAGE, LAST_STAGE)


def _contact(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("id", "name", "role", "email")])


def _company_facts(s: Snapshot, rules: Rules) -> DataFrame:
    """Per company: domain, whether it takes mail, duplicate guard, best contact, research outcome."""
    domains = s.companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), company_domain("domain", "name").alias("domain"))
    facts = with_mail_flag(domains, F.lower(strip("domain")), s.mail_domains, "company_id")
    best = s.contacts.groupBy("company_id").agg(
        F.min_by(_contact(), F.struct(role_rank("role", rules), "id")).alias("best"))
    guarded = guarded_companies(s.contacts, s.applications).select(
        "company_id", F.lit(True).alias("_guarded"))
    facts = facts.join(best, "company_id", "left").join(guarded, "company_id", "left")
    if s.research is not None:
        facts = facts.join(s.research.select("company_id", "research_ok"), "company_id", "left")
    return facts.withColumn("guarded", F.coalesce("_guarded", F.lit(False))).drop("_guarded")


def _own_rows(s: Snapshot, rows: DataFrame) -> DataFrame:
    """Per application of ``rows``: latest message, whether a resume version exists."""
    ids = rows.select(F.col("id").alias("application_id"))
    mail = last_per(s.emails.select("application_id", "id", "status", "created_at").join(ids, "application_id", "left_semi"),
                    ["application_id"], "id").select(
        "application_id", F.struct("id", "status", "created_at").alias("mail"))
    resume = s.resumes.select("application_id").join(ids, "application_id", "left_semi").distinct() \
        .withColumn("resume", F.lit(True))
    return mail.join(resume, "application_id", "full")


def gate_inputs(s: Snapshot, rules: Rules, closed: Sequence[str] = RUN_TERMINAL) -> DataFrame:
    """Movable applications with everything their gates look at."""
    rows = s.applications.where(movable(closed))
    rows = rows.select("id", "run_id", "job_id", "contact_id",
                       F.col("current_stage").cast("int").alias("start"), "state", "score")
    signals = s.signals.withColumnRenamed("application_id", "id")
    if s.research is not None and "research_ok" in signals.columns:
        signals = signals.drop("research_ok")
    own = _own_rows(s, rows).withColumnRenamed("application_id", "id")
    rows = rows.join(signals, "id", "left").join(own, "id", "left")
    if s.answers is None:
        rows = rows.join(s.scores.withColumnRenamed("application_id", "id"), "id", "left")
    else:
        rows = with_outcomes(rows.join(s.answers.withColumnRenamed("application_id", "id"), "id", "left"))
    rows = weighted_scores(rows.withColumnRenamed("score", "_old"), rules).withColumnRenamed("score", "new_score") \
        .withColumnRenamed("_old", "score").drop(*rules.COMPONENTS)

    jobs = s.jobs.select(F.col("id").alias("job_id"), "company_id", F.col("title").alias("job_title"))
    rows = lookup(rows.join(jobs, "job_id"), _company_facts(s, rules), ["company_id"], ["company_id"],
                  how="inner")

    linked = s.contacts.select(F.col("id").alias("_cid"), _contact().alias("linked"))
    rows = lookup(rows, linked, ["contact_id"], ["_cid"], "id")

    # Contact in force from stage 5 on: the linked one, else (only if stage 4 runs) the best one of
    # the company, else a stand-in.
    stand_in = F.struct(F.lit(None).cast("bigint").alias("id"), F.lit(PLACEHOLDER_NAME).alias("name"),
                        F.lit(PLACEHOLDER_ROLE).alias("role"), F.lit(None).cast("string").alias("email"))
    contact = F.when(F.col("linked").isNotNull(), F.col("linked")).when(
        F.col("start") <= 4, F.coalesce("best", stand_in))
    rows = rows.withColumn("contact", contact)
    known = filled("contact.email")
    searched = (F.col("start") <= 5) & ~known
    guess = F.when(searched & F.col("mail_ok"), first_sound_mailbox("contact.name", "domain"))
    if s.mailboxes is not None:
        # An address that was found comes before the guesses, whatever its domain.
        answers = s.mailboxes.select(F.col("contact_id").alias("_mid"), strip("answer").alias("answer"))
        rows = lookup(rows, answers, [F.when(searched, F.col("contact.id"))], ["_mid"], "id")
        sound = F.when(mailbox_ok("answer"), mail_domain("answer"))
        rows = with_mail_flag(rows, sound, s.mail_domains, "id", "answer_ok")
        guess = F.when(F.col("answer_ok"), F.col("answer")).otherwise(guess)
    rows = rows.withColumn("guess", guess)

    owners = mailbox_owners(s.contacts).select(F.col("email").alias("_email"), "owner")
    return lookup(rows, owners, ["guess"], ["_email"], "id")


@dataclass(frozen=True)
class Gate:
    passes: Column
    failed_state: Column
    logs_failure: Column
    logs_success: Column


def _yes(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def gates() -> dict[int, Gate]:
    """One gate per stage over the columns of :func:`gate_inputs`."""
    true = F.lit(True)
    start = F.col("start")
    linked = F.col("linked").isNotNull()
    has_contact = F.col("contact").isNotNull()
    known = filled("contact.email")
    # A row that ran stage 5 in this run has a mailbox by then; others need a stored one.
    addressed = (start <= 5) | F.col("contact.email").isNotNull()
    has_mail = (start <= 8) | F.col("mail").isNotNull()
    has_resume = (start <= 7) | _yes("resume")
    scored = F.col("passes").isNotNull()

    def state(text: str) -> Column:
        return F.lit(text)

    return {
        3: Gate(_yes("research_ok"), state("Research Failed"), true, true),
        4: Gate(linked | ~F.col("guarded"), state("Duplicate"), true, ~linked),
        5: Gate(has_contact & (known | F.col("guess").isNotNull()),
                F.when(has_contact, "No Professional Email").otherwise("Failed"), true, ~known),
        6: Gate(_yes("passes"), F.when(scored, "Salary Too Low").otherwise("Failed"), true, true),
        7: Gate(_yes("tailor_ok"), state("Failed"), true, true),
        8: Gate(has_contact, state("Failed"), true, true),
        9: Gate(has_mail & has_resume & F.coalesce(F.col("valid_ok"), true),
                state("Validation Failed"), has_mail & has_resume, true),
        10: Gate(has_contact & has_mail & addressed & _yes("draft_ok"),
                 F.when(has_contact & ~has_mail, "Draft Failed")
                 .when(has_contact & addressed, "Draft Failed").otherwise("Failed"),
                 ~(has_contact & ~has_mail), true),
        11: Gate(true, state("Failed"), true, true),
    }


def _pick(stage: Column, values: dict[int, Column]) -> Column:
    out = None
    for s, v in values.items():
        out = F.when(stage == s, v) if out is None else out.when(stage == s, v)
    return out


# What a run stores with its messages and resumes; the gates look at none of it.
TEXTS = ("keywords", "reasoning", "subject", "body_html")


def verdicts(s: Snapshot, rules: Rules, closed: Sequence[str] = RUN_TERMINAL, texts: bool = False) -> DataFrame:
    """Movable rows with the verdict of every gate from their own stage on, and with the written ``texts`` if asked for.

    ``fails`` lists the failing stages in order, so the first element not above a bound is where a run with that bound
    stops; ``failed`` has the state each would leave, ``quiet`` the stages that log nothing. Written to the
    shared folder, as everything else reads it.
    """
    all_gates = gates()
    rows = gate_inputs(s, rules, closed)
    hit = [F.when((F.col("start") <= k) & ~g.passes, F.struct(F.lit(k).alias("stage"), g.failed_state.alias("state"),
                                                            g.logs_failure.alias("logged"))) for k, g in all_gates.items()]
    silent = [F.when(~g.logs_success, F.lit(k)) for k, g in all_gates.items()]
    rows = rows.withColumn("fails", F.array_compact(F.array(*hit))).withColumn("quiet", F.array_compact(F.array(*silent)))
    rows = rows.withColumn("mailbox", F.when(filled("contact.email"), F.col("contact.email")).otherwise(F.col("guess")))
    unused = ("research_ok", "tailor_ok", "valid_ok", "guarded", "best", "resume", "answer", "answer_ok", "mail_ok", "domain")
    return staged(rows.drop(*unused, *() if texts else TEXTS), "verdicts")


def _ran(stage: int) -> Column:
    """The row passed this stage in this run."""
    return (F.col("start") <= stage) & (F.col("end") > stage)


def _open() -> Column:
    """Rows that choose their contact in this run: the duplicate guard looks at them, at stage 4."""
    return (F.col("start") <= 4) & F.col("linked").isNull()


def _stopped(rows: DataFrame, max_stage: int, taken: Column | None = None) -> DataFrame:
    """``stop`` (failing stage or null), ``end`` (stage reached) and ``end_state`` under a bound."""
    first = F.get(F.filter("fails", lambda f: f["stage"] <= max_stage), F.lit(0))
    if taken is not None and max_stage >= 4:
        late = taken & F.coalesce(first["stage"] >= 4, F.lit(True))
        first = F.when(late, F.struct(F.lit(4).alias("stage"), F.lit("Duplicate").alias("state"), F.lit(True).alias("logged"))) \
            .otherwise(first)
    landing = F.lit(min(max_stage, LAST_STAGE) + 1)
    if max_stage == 4:
        # A linked contact with a mailbox leaves stage 4 for 6 directly.
        skips = F.col("linked").isNotNull() & filled("linked.email")
        landing = F.when(skips, 6).otherwise(5)
    untouched = F.col("start") > max_stage
    rows = rows.withColumn("_first", first)
    end = F.when(untouched, F.col("start")).when(F.col("_first").isNotNull(), F.col("_first.stage")).otherwise(landing)
    rows = rows.withColumn("end", end.cast("int")).withColumn("stop", F.when(~untouched, F.col("_first.stage")))
    entered = _pick(F.col("end"), {k: F.lit(v) for k, v in STATE_ON_ENTRY.items()})
    return rows.withColumn("end_state", F.when(untouched, F.col("state")).when(F.col("stop").isNotNull(), F.col("_first.state"))
                           .otherwise(entered)).withColumn("stop_logged", _yes("_first.logged")).drop("_first")


def _firsts(contacted: DataFrame, key: str, out: str) -> DataFrame:
    """Lowest id that contacts each company or mailbox."""
    return contacted.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(F.min("id").alias(out))


def _with_firsts(rows: DataFrame, contacted: DataFrame, company: str, mailbox: str) -> DataFrame:
    rows = lookup(rows, _firsts(contacted, "company_id", company), ["company_id"], ["_company_id"], "id")
    return lookup(rows, _firsts(contacted, "mailbox", mailbox), ["mailbox"], ["_mailbox"], "id")


def contacted_in_order(candidates: DataFrame) -> DataFrame:
    """The candidates that write to somebody when all go in id order.

    ``candidates(id, company_id, mailbox, open)``: an open row gives way to any row before it that writes to its
    company or to its mailbox; others write in any case. Solved as sets: in each round a row before which nobody of its
    company or mailbox is left wins, and open rows behind a winner of theirs leave. A round decides
    the lowest undecided row of every group no other group holds up, so there are as many rounds as the
    longest chain of rows that wait for each other through company and mailbox by turns: one, unless companies share mailboxes.
    """
    alive = staged(candidates.select("id", "company_id", F.nullif("mailbox", F.lit("")).alias("mailbox"), "open",
                                     (~F.col("open")).alias("won")), "candidates")
    while not alive.where(~F.col("won")).isEmpty():
        rows = _with_firsts(alive, alive, "c_low", "m_low")
        free = (F.col("id") <= F.col("c_low")) & F.coalesce(F.col("id") <= F.col("m_low"), F.lit(True))
        rows = rows.withColumn("won", F.col("won") | free).drop("c_low", "m_low")
        rows = _with_firsts(rows, rows.where("won"), "c_won", "m_won")
        behind = _yes(F.col("c_won") < F.col("id")) | _yes(F.col("m_won") < F.col("id"))
        alive = staged(rows.where(F.col("won") | ~behind).drop("c_won", "m_won"), "candidates")
    return alive


def settled(judged_rows: DataFrame, max_stage: int = DONE_STAGE) -> DataFrame:
    """Judged rows under a bound, duplicates inside the run included.

    A row that chooses its contact in this run is a duplicate if a row before it, by id, writes to its company or its
    mailbox in the same run. Writing is reaching a state that counts as contacted, or making a draft.
    """
    if max_stage < 7:  # no such state is reached
        return _stopped(judged_rows, max_stage)
    reached = _stopped(judged_rows, max_stage)
    writes = (F.col("start") <= max_stage) & (F.col("end_state").isin(*CONTACTED) | _ran(10))
    contacted = contacted_in_order(reached.where(writes).withColumn("open", _open()))
    marked = _with_firsts(judged_rows, contacted, "_c_first", "_m_first")
    taken = _open() & (_yes(F.col("_c_first") < F.col("id")) | _yes(F.col("_m_first") < F.col("id")))
    return _stopped(marked, max_stage, taken).drop("_c_first", "_m_first")


def judged(s: Snapshot, rules: Rules, max_stage: int = DONE_STAGE,
           closed: Sequence[str] = RUN_TERMINAL, texts: bool = False) -> DataFrame:
    """Movable rows with ``stop`` (failing stage or null), ``end`` (stage reached) and ``end_state``."""
    return settled(verdicts(s, rules, closed, texts), max_stage)


def _chosen() -> Column:
    """The row got its contact in this run."""
    return _ran(4) & F.col("linked").isNull()


def _resolved() -> Column:
    """The row found a mailbox for its contact in this run."""
    return _ran(5) & ~filled("contact.email")


def created_contacts(moved: DataFrame, contacts: DataFrame) -> DataFrame:
    """Stand-in contacts a run makes, one for each company without any: ``(company_id, id, name, role, linkedin_url)``.

    Ids follow the order of the rows that needed them first.
    """
    needed = moved.where(_chosen() & F.col("contact.id").isNull()).groupBy("company_id").agg(
        F.min("id").alias("ordinal"), F.min("company_name").alias("company_name"))
    numbered = dense_ids(staged(needed, "stand-ins"), "ordinal", "id", contacts.agg(F.max("id")))
    return numbered.select(
        "company_id", "id", F.lit(PLACEHOLDER_NAME).alias("name"), F.lit(PLACEHOLDER_ROLE).alias("role"),
        F.concat(F.lit("https://linkedin.com/company/"), F.lower("company_name")).alias("linkedin_url"))


def with_contacts(moved: DataFrame, contacts: DataFrame) -> DataFrame:
    """Rows of a run with the contact they end with: ``own_contact`` (chosen or linked) and ``final_contact``.

    A mailbox belongs to the stored contact that has it, else to the contact of the first row that finds it in this run
    (``setter``); a row that finds one owned by another contact is linked to that one. A contact linked to rows of several
    companies keeps the first mailbox found for it. The rows are read three times, so they are written once.
    """
    moved = staged(moved, "moved")
    made = created_contacts(moved, contacts).select(F.col("company_id").alias("_company"), F.col("id").alias("_made"))
    rows = lookup(moved, made, [F.when(_chosen() & F.col("contact.id").isNull(), F.col("company_id"))], ["_company"], "id")
    rows = rows.withColumn("own_contact", F.coalesce("contact.id", "_made")).drop("_made")
    found = rows.where(_resolved() & F.col("owner").isNull())
    setters = found.groupBy(F.col("guess").alias("_guess")).agg(F.min_by(F.struct("id", "own_contact"), "id").alias("setter"))
    rows = lookup(rows, setters, [F.when(_resolved(), F.col("guess"))], ["_guess"], "id")
    final = F.when(_resolved(), F.coalesce("owner", "setter.own_contact", "own_contact")) \
        .when(_chosen(), F.col("own_contact")).otherwise(F.col("contact_id"))
    return rows.withColumn("final_contact", final)


def _moved_rows(rows: DataFrame) -> DataFrame:
    mailbox = F.when(_resolved(), F.col("guess")) \
        .when(_chosen(), F.col("contact.email")).otherwise(F.col("linked.email"))
    scored = (F.col("start") <= 6) & (F.col("end") >= 6) & F.col("passes").isNotNull() & (
        (F.col("end") > 6) | F.col("stop").isNotNull())
    return rows.select(
        "id", F.col("start").alias("old_stage"), F.col("state").alias("old_state"),
        F.col("end").alias("current_stage"), F.col("end_state").alias("state"),
        F.col("final_contact").alias("contact_id"), mailbox.alias("contact_email"),
        F.when(scored, F.col("new_score")).otherwise(F.col("score")).alias("score"))


def _resting_rows(applications: DataFrame, closed: Sequence[str] = RUN_TERMINAL) -> DataFrame:
    return applications.where(~movable(closed)).select(
        "id", F.col("current_stage").cast("int").alias("old_stage"), F.col("state").alias("old_state"),
        F.col("current_stage").cast("int"), "state", "contact_id",
        F.lit(None).cast("string").alias("contact_email"), "score")


def _held(s: Snapshot, moving: DataFrame, daily_limit: int, as_of: str) -> DataFrame:
    """Rows from the first refused draft on put back to where they were."""
    moving = staged(moving, "moving")
    cut = quota_break(s, moving, daily_limit, as_of).scalar()
    held = F.coalesce(cut.isNotNull() & (F.col("id") >= cut), F.lit(False))
    return moving.withColumn("end", F.when(held, F.col("start")).otherwise(F.col("end"))) \
        .withColumn("end_state", F.when(held, F.col("state")).otherwise(F.col("end_state"))) \
        .withColumn("stop", F.when(~held, F.col("stop")))


def advance(s: Snapshot, rules: Rules, max_stage: int = DONE_STAGE,
            daily_limit: int | None = None, as_of: str | None = None) -> DataFrame:
    """Every application with its stage, state, contact and score after one run.

    With ``daily_limit`` rows from the first refused draft on stay as they are (see
    :func:`quota_break`); ``as_of`` then names the day.
    """
    moving = judged(s, rules, max_stage)
    if daily_limit is not None:
        moving = _held(s, moving, daily_limit, as_of)
    return _moved_rows(with_contacts(moving, s.contacts)).unionByName(_resting_rows(s.applications))


def advance_to(s: Snapshot, rules: Rules, bounds: Sequence[int]) -> DataFrame:
    """``(max_stage, id, current_stage, state)`` after runs with several bounds, all from one judgement."""
    rows = verdicts(s, rules)
    out = None
    for bound in bounds:
        moved = settled(rows, bound).select("id", F.col("end").alias("current_stage"), F.col("end_state").alias("state"))
        still = _resting_rows(s.applications).select("id", "current_stage", "state")
        one = moved.unionByName(still).select(F.lit(bound).alias("max_stage"), "id", "current_stage", "state")
        out = one if out is None else out.unionByName(one)
    return out


def drafting(moving: DataFrame) -> DataFrame:
    """Rows of a run that make a draft."""
    return moving.where(_ran(10))


def _day_start(as_of: str) -> Column:
    return F.date_trunc("day", F.lit(as_of).cast("timestamp")).cast("timestamp_ntz")


def quota_break(s: Snapshot, moving: DataFrame, daily_limit: int, as_of: str) -> DataFrame:
    """Id of the first row refused by the daily limit (one row, null when none is).

    Rows run in id order. A row waiting at stage 10 is refused when the drafts of today, before it,
    reach the limit; the run ends there. Only ``daily_limit`` smallest drafting ids are ever ranked,
    so no running count over the whole table is needed.
    """
    # A draft counts for today if its message was written today (also: in this run).
    fresh = (F.col("start") <= 8) | (
        (F.col("mail.created_at") >= _day_start(as_of)) & (F.col("mail.status") != "draft_created"))
    left = F.lit(daily_limit) - drafts_on_day(s.emails, as_of).scalar()
    kth = _kth_smallest(drafting(moving).where(fresh), left, daily_limit, none=None).scalar()
    waiting = moving.where((F.col("start") == 10) & (F.col("id") > kth))
    return waiting.agg(F.min("id").alias("break_id"))


def _kth_smallest(rows: DataFrame, k: Column, limit: int, none: int | None) -> DataFrame:
    """The ``k``-th smallest id (``k`` <= ``limit``): -1 for ``k`` <= 0, ``none`` when there are fewer.

    A top-``limit`` selection; ``limit`` is the daily draft limit, a setting, not data.
    """
    ids = rows.select("id").orderBy("id").limit(limit).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    found = F.coalesce(F.get("ids", (k - 1).cast("int")), F.lit(none).cast("bigint"))
    return ids.select(F.when(k <= 0, F.lit(-1).cast("bigint")).otherwise(found).alias("kth"))


def quota_admission(s: Snapshot, rules: Rules, as_of: str, daily_limit: int | None = None) -> DataFrame:
    """Per movable row whether a run with the daily limit would process it.

    ``admitted`` follows the run order rule of :func:`quota_break`; ``within_cap`` is the strict
    reading, in which no draft beyond the limit is made. A limit of zero means the default one.
    The judged rows are read several times, so they are written to the shared folder once.
    """
    limit = daily_limit or rules.daily_draft_limit
    moving = staged(judged(s, rules).select("id", "start", "end", "mail"), "judged")
    cut = quota_break(s, moving, limit, as_of).scalar()
    left = F.lit(limit) - drafts_on_day(s.emails, as_of).scalar()
    last = _kth_smallest(drafting(moving), left, limit, none=9223372036854775807).scalar()
    return moving.select(
        "id", F.coalesce(F.col("id") < cut, F.lit(True)).alias("admitted"),
        (~_ran(10) | (F.col("id") <= last)).alias("within_cap"))


def retry_reset(applications: DataFrame) -> DataFrame:
    """Failed rows put back to the stage their state restarts at; the others unchanged.

    Adds ``note`` (null when unchanged), which is also the reset's history entry.
    """
    failed = F.col("state").isin(*RETRYABLE)
    stage = F.lit(RETRY_DEFAULT_STAGE)
    for state, target in RETRY_STAGE.items():
        stage = F.when(F.col("state") == state, target).otherwise(stage)
    entered = _pick(stage, {t: F.lit(STATE_ON_ENTRY[t])
                            for t in {*RETRY_STAGE.values(), RETRY_DEFAULT_STAGE}})
    return applications.select(
        "id", F.when(failed, stage).otherwise(F.col("current_stage")).cast("int").alias("current_stage"),
        F.when(failed, entered).otherwise(F.col("state")).alias("state"),
        F.when(failed, F.concat(F.lit("retry after "), "state")).alias("note"))


def retry_history(applications: DataFrame, run_id: str, as_of: str) -> DataFrame:
    """History rows of a reset, with its run, time and note: one per failed row."""
    reset = retry_reset(applications).where(F.col("note").isNotNull())
    return reset.select(F.col("id").alias("application_id"), F.col("current_stage").alias("stage"), "state",
                        F.lit(run_id).alias("run_id"), F.lit(as_of).cast("timestamp_ntz").alias("timestamp"),
                        F.col("note").alias("notes"))


def screening_history(entered: DataFrame, run_id: str, as_of: str) -> DataFrame:
    """History rows of a screening, from :func:`hirelake.operators.filtering.enter_screening`: its outcome for each
    new row, entered at stage 2, and one more for a row that goes on to stage 3."""
    new = entered.where("is_new")
    opening = F.struct(F.lit(2).alias("stage"), F.when(F.col("current_stage") == 2, F.col("state")).otherwise("Filtering").alias("state"),
                       F.when(F.col("current_stage") == 2, F.col("note")).otherwise("entered").alias("note"))
    onward = F.when(F.col("current_stage") > 2, F.struct(
        F.col("current_stage").alias("stage"), F.col("state").alias("state"), F.col("note").alias("note")))
    rows = new.select("job_id", F.posexplode(F.array_compact(F.array(opening, onward))).alias("step", "e"))
    return rows.select("job_id", "step", "e.stage", "e.state", F.lit(run_id).alias("run_id"),
                       F.lit(as_of).cast("timestamp_ntz").alias("timestamp"), F.col("e.note").alias("notes"))


def override_states(applications: DataFrame, corrections: DataFrame, as_of: str) -> DataFrame:
    """Apply manual corrections ``(application_id, seq, state)``; the last one per row wins.

    A correction without a state changes nothing. The stage is left alone; ``updated_at`` is set on changed rows.
    """
    final = last_per(corrections.where(F.col("state").isNotNull()), ["application_id"], "seq").select(
        F.col("application_id").alias("id"), F.col("state").alias("_new"))
    joined = applications.join(final, "id", "left")
    changed = F.col("_new").isNotNull()
    return joined.withColumn("state", F.coalesce("_new", "state")).withColumn(
        "updated_at", F.when(changed, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at"))
    ).drop("_new")


def _jobs_of(jobs: DataFrame, targets: DataFrame) -> DataFrame:
    """Jobs of the target companies ``(id)``, one of which may own most jobs."""
    return lookup(jobs, targets.select("id").distinct(), ["company_id"], ["id"], how="left_semi")


def link_contact(applications: DataFrame, jobs: DataFrame, targets: DataFrame,
                 contact_id: int) -> DataFrame:
    """Point the open applications of the target companies ``(id)`` to a supplied contact."""
    hit = _jobs_of(jobs, targets).select(F.col("id").alias("job_id"), F.lit(True).alias("_hit"))
    return applications.join(hit, "job_id", "left").withColumn(
        "contact_id", F.when(F.col("_hit") & ~F.col("state").isin(*REFILTER_CLOSED), F.lit(contact_id))
        .otherwise(F.col("contact_id")).cast("bigint")).drop("_hit")


def targeted_entries(jobs: DataFrame, companies: DataFrame, applications: DataFrame, rules: Rules,
                     targets: DataFrame, honour_exclusions: bool = True) -> DataFrame:
    """Applications a targeted run works on: the open ones of the targets' jobs, and new ones.

    A target on the exclusion list is still screened out unless ``honour_exclusions`` is off.
    """
    own = _jobs_of(jobs, targets)
    active = rules if honour_exclusions else replace(rules, excluded_companies=())
    return enter_screening(own, companies, applications, active)


def advance_targeted(s: Snapshot, rules: Rules, targets: DataFrame, contact_id: int | None = None,
                     max_stage: int = DONE_STAGE) -> DataFrame:
    """Advance only the applications of the target companies ``(id)``.

    A supplied contact is linked to all of them first. States a screening does not close
    (duplicates and failures among them) run their stage again. Guards look at the whole tables.
    """
    jobs = _jobs_of(s.jobs, targets)
    linked = s.applications if contact_id is None else link_contact(
        s.applications, s.jobs, targets, contact_id)
    own = replace(s, applications=linked, jobs=jobs)
    return _moved_rows(with_contacts(judged(own, rules, max_stage, closed=REFILTER_CLOSED), s.contacts))
