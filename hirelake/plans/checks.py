"""SQL twins of the registered queries, for any ANSI engine over the same parquet tables."""

from __future__ import annotations

from hirelake.functions.mail import MAILBOX
from hirelake.functions.text import WHITESPACE
from hirelake.operators import audit
from hirelake.operators.messages import signature
from hirelake.rules import (
    CLEARED_EMAIL_STATES,
    CLI_FILTERED,
    CONTACTED,
    NO_EMAIL_STATES,
    REFILTER_CLOSED,
    RETRYABLE,
    RUN_TERMINAL,
    SEED_BLOCKED_DOMAINS,
    STAGE_LABELS,
    STATE_ON_ENTRY,
    WEB_FILTERED,
    WEB_TERMINAL,
)
from hirelake.rules import FIXTURE_RULES as RULES
from hirelake.sources.views import EVENTS_AS_OF, ORDERS_AS_OF, SLICES, with_prelude


# The twin's own reading of markup: enough for the pages of the fixture.
OPAQUE = "(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>"
CHROME = "(?is)<(?:header|footer|nav)\\b[^>]*>.*?</(?:header|footer|nav)\\s*>"
TAG = "<(?:![^>]*|/?[a-zA-Z][^>]*)>"
REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "\u00a9", "not": "\u00ac", "eacute": "\u00e9", "middot": "\u00b7", "amp": "&"}


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(column: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {default} END"


def _strip(c: str) -> str:
    return f"trim({c}, '{WHITESPACE}')"


def _time(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _label(a: str = "a") -> str:
    return _case(f"{a}.current_stage", STAGE_LABELS, f"{a}.state")


def _decode(c: str) -> str:
    """Percent-decoding; the fixture texts hold no broken escapes."""
    return f"url_decode({c})"


EXPORT_DAY = "1996-01-01 00:00:00"
# Repeats of a delivery are known for so long.
DEDUP_HOURS = 72
# What a correction makes of an application, by kind of event; views correct nothing.
OVERRIDES = {"purchase": "Manual Skip", "signup": "Skipped", "error": "Failed", "click": "Timeout"}

# --- shared fragments ------------------------------------------------------------------------
EXCLUDED = "contains(lower(c.name), '00000007')"
TITLE = "contains(lower(j.title), 'specified')"
YEARS = "coalesce(j.experience_years_required, 0) > 1.0"
URL = f"nullif({_strip('url')}, '')"

_HOST = ("regexp_replace(lower(regexp_extract({u}, '^[\\x00-\\x20]*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), "
         "'^www\\.', '')")


def _host(u: str) -> str:
    return _HOST.format(u=u)


REDIRECT_RAW = _strip("href")
REDIRECT = (
    f"CASE WHEN contains({REDIRECT_RAW}, 'uddg=') THEN "
    f"{_strip(_decode('split_part(split_part(' + REDIRECT_RAW + ', ' + repr('uddg=') + ', 2), ' + repr('&') + ', 1)'))} "
    f"ELSE {REDIRECT_RAW} END")

DENIED = f"""denied AS (SELECT DISTINCT {_host('url')} AS domain FROM pages
             WHERE contains({_host('url')}, 'casino') OR contains({_host('url')}, 'pills'))"""


def _top_hits(n: int) -> str:
    return f"""cleaned AS (SELECT *, {REDIRECT} AS raw_target FROM v_hits),
      located AS (SELECT *, CASE WHEN starts_with(raw_target, '//') THEN 'https:' || raw_target ELSE raw_target END AS target FROM cleaned),
      allowed AS (SELECT *, {_host('target')} AS domain FROM located WHERE {_host('target')} NOT IN (SELECT domain FROM denied)),
      ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rank FROM allowed),
      top AS (SELECT * FROM ranked WHERE rank <= {n})"""


def _entities(c: str, attribute: bool = False) -> str:
    """The references of the test pages; all of these names may stand without their semicolon."""
    for name, char in REFERENCES.items():
        end = "(?:;|([^=a-zA-Z0-9]|$))" if attribute else ";?"
        c = f"regexp_replace({c}, '&{name}{end}', '{char}{chr(92) + '1' if attribute else ''}', 'g')"
    return c


_RUN = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2028}\x{2029}]*"
_BREAK = r"(?:[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]|  )"


def _page_text(html: str) -> str:
    for pattern in (OPAQUE, CHROME, TAG):
        html = f"regexp_replace({html}, '{pattern}', chr(10), 'g')"
    return _strip(f"regexp_replace({_entities(html)}, '{_RUN}{_BREAK}{_RUN}', chr(10), 'g')")


FENCE = "(?s)```(?:json)?\\s*(.*?)\\s*```"
UNFENCED = _strip(f"CASE WHEN regexp_matches(raw, '{FENCE}') THEN regexp_extract(raw, '{FENCE}', 1) ELSE raw END")

SOUND = f"(coalesce(email, '') <> '' AND regexp_matches({_strip('email')}, '{MAILBOX}'))"
VERDICTS = f"""verdicts AS (SELECT c.*, CASE WHEN coalesce(email, '') = '' THEN 'empty' WHEN NOT {SOUND} THEN 'syntax'
      WHEN lower(split_part({_strip('email')}, '@', 2)) NOT IN (SELECT domain FROM v_mx WHERE accepts_mail) THEN 'domain' ELSE 'ok' END AS verdict
      FROM v_contacts c)"""

DOMAIN = "coalesce(nullif(domain, ''), replace(lower(name), ' ', '') || '.com')"


def _guesses(name: str, domain: str) -> str:
    """Guess list of two-word names (all fixture names have two words)."""
    f, last = f"split_part(lower({name}), ' ', 1)", f"split_part(lower({name}), ' ', 2)"
    at = f"'@' || lower({domain})"
    return (f"[{f} || '.' || {last} || {at}, {f} || {at}, substr({f}, 1, 1) || '.' || {last} || {at}, "
            f"{f} || {last} || {at}, {last} || '.' || {f} || {at}, 'careers' || {at}]")


# What a run finds in its cache, and in answers for the rest.
LIVE_ENTRIES = f"""kept AS (SELECT key, arg_max(value, version) AS value, arg_max(expires_at, version) AS expires_at FROM v_run_cache GROUP BY key),
      live AS (SELECT * FROM kept WHERE expires_at >= TIMESTAMP '{ORDERS_AS_OF}' AND value NOT IN ('', '[]', '{{}}', 'null', '""'))"""
RESEARCH = f"""{LIVE_ENTRIES},
      researched AS (SELECT c.id AS company_id, l.key IS NOT NULL AS hit, l.key IS NOT NULL OR json_valid(a.raw) AS research_ok
        FROM v_companies c LEFT JOIN live l ON l.key = 'company_research_' || lower(c.name)
        LEFT JOIN v_research_answers a ON a.company_id = c.id)"""
MAILBOXES = f"""asked AS (SELECT p.id AS contact_id, 'email_' || lower(c.name) || '_' || replace(lower(p.name), ' ', '_') AS key
        FROM v_contacts p JOIN v_companies c ON p.company_id = c.id),
      mailboxes AS (SELECT contact_id, answer FROM (SELECT k.contact_id, coalesce(l.value,
          CASE WHEN json_valid(a.raw) THEN json_extract_string(CASE WHEN json_valid(a.raw) THEN a.raw END, '$.email') END) AS answer
        FROM asked k LEFT JOIN live l USING (key) LEFT JOIN v_mailbox_answers a USING (contact_id)) WHERE answer <> '')"""

FIRST_GUESS = f"""domains AS (SELECT id AS company_id, {DOMAIN} AS domain FROM v_companies),
      guessed AS (SELECT c.*, d.domain, {_guesses('c.name', 'd.domain')} AS guesses FROM v_contacts c JOIN domains d USING (company_id))"""
_VALID = f"""valid AS (SELECT id, arg_min(g, pos) AS mailbox FROM tried WHERE regexp_matches(g, '{MAILBOX}')
        AND lower(split_part(g, '@', 2)) IN (SELECT domain FROM v_mx WHERE accepts_mail) GROUP BY id)"""
FIRST_VALID = f"""{FIRST_GUESS},
      tried AS (SELECT id, unnest(guesses) AS g, generate_subscripts(guesses, 1) AS pos FROM guessed), {_VALID}"""
FIRST_FOUND = f"""{LIVE_ENTRIES}, {MAILBOXES}, {FIRST_GUESS},
      tried AS (SELECT id, unnest(guesses) AS g, generate_subscripts(guesses, 1) AS pos FROM guessed
        UNION ALL SELECT contact_id, {_strip('answer')}, 0 FROM mailboxes), {_VALID}"""

RANK = """CASE WHEN contains(lower(role), 'promo') THEN 0 WHEN contains(lower(role), 'economy') THEN 1
      WHEN contains(lower(role), 'standard') THEN 2 ELSE 3 END"""

GUARD = f"""first_mail AS (SELECT company_id, min(id) AS contact_id FROM v_contacts WHERE email IS NOT NULL GROUP BY company_id),
      guarded AS (SELECT company_id FROM first_mail WHERE contact_id IN
        (SELECT contact_id FROM v_applications WHERE state IN {_in(CONTACTED)}))"""

SCORE = " + ".join(f"{c} * CAST({RULES.weights[c]} AS DOUBLE)" for c in RULES.COMPONENTS)

LATEST_MAIL = """latest_mail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY id DESC) AS rn
      FROM v_emails) WHERE rn = 1)"""

_TTL = f"to_seconds(coalesce(ttl_seconds, {RULES.cache_ttl_seconds}))"
ENTRIES = f"""written AS (SELECT *, created_at + {_TTL} AS expires_at,
        row_number() OVER (PARTITION BY key ORDER BY created_at DESC, version DESC) AS rn FROM v_cache),
      entries AS (SELECT * FROM written WHERE rn = 1)"""
REQUESTS = """requests AS (SELECT id AS request_id, state || ':' || CAST(application_id + stage AS VARCHAR) AS key FROM v_history)"""
LIVE = f"expires_at >= TIMESTAMP '{EVENTS_AS_OF}'"

MOVABLE = "state NOT IN {closed} AND current_stage BETWEEN 3 AND 11"


JSON_SCORE = " + ".join(f"CAST(json_extract(score, '$.{c}') AS DOUBLE) * CAST({RULES.weights[c]} AS DOUBLE)" for c in RULES.COMPONENTS)


def _ending(max_stage: int, stop: str) -> tuple[str, str]:
    """Stage reached and state, given the column of the failing stage."""
    landing = min(max_stage, 11) + 1
    failed = f"""CASE {stop} WHEN 3 THEN 'Research Failed' WHEN 4 THEN 'Duplicate'
        WHEN 5 THEN CASE WHEN contact_name IS NOT NULL THEN 'No Professional Email' ELSE 'Failed' END
        WHEN 6 THEN CASE WHEN passes IS NOT NULL THEN 'Salary Too Low' ELSE 'Failed' END
        WHEN 7 THEN 'Failed' WHEN 8 THEN 'Failed' WHEN 9 THEN 'Validation Failed'
        WHEN 10 THEN CASE WHEN contact_name IS NULL THEN 'Failed' WHEN NOT has_mail THEN 'Draft Failed'
                          WHEN addressed THEN 'Draft Failed' ELSE 'Failed' END END"""
    end = f"CASE WHEN start > {max_stage} THEN start WHEN {stop} IS NOT NULL THEN {stop} ELSE {landing} END"
    state = f"CASE WHEN start > {max_stage} THEN old_state WHEN {stop} IS NOT NULL THEN {failed} ELSE '{STATE_ON_ENTRY.get(landing)}' END"
    return end, state


def _judged(max_stage: int, closed=RUN_TERMINAL, applications: str = "v_applications",
            where: str = "true") -> str:
    """The advance as SQL: one column per gate, the first failing stage, then the rows that write to somebody one after
    the other: a row that chooses its contact is a duplicate behind one that wrote to its company or mailbox."""
    gates = {
        3: "coalesce(research_ok, false)",
        4: "linked_id IS NOT NULL OR NOT is_guarded",
        5: "contact_name IS NOT NULL AND (known OR guess IS NOT NULL)",
        6: "coalesce(passes, false)",
        8: "contact_name IS NOT NULL",
        9: "has_mail AND has_resume AND coalesce(valid_ok, true)",
        10: "contact_name IS NOT NULL AND has_mail AND addressed AND coalesce(draft_ok, false)",
        11: "true",
    }
    stops = [f"WHEN start <= {s} AND NOT ({g}) THEN {s}" for s, g in gates.items() if s <= max_stage]
    stop = f"CASE {' '.join(stops)} END" if stops else "CAST(NULL AS INTEGER)"
    end0, state0 = _ending(max_stage, "stop0")
    end, state = _ending(max_stage, "stop")
    free = "NOT c.open OR NOT (list_contains(w.companies, c.company_id) OR coalesce(list_contains(w.mails, c.mailbox), false))"

    def grown(name: str, column: str) -> str:
        return f"CASE WHEN {free} THEN list_append(w.{name}, c.{column}) ELSE w.{name} END"

    return f"""RECURSIVE {GUARD}, {LATEST_MAIL}, {RESEARCH}, {MAILBOXES},
      best AS (SELECT * FROM (SELECT company_id, id, name, email, row_number() OVER
        (PARTITION BY company_id ORDER BY {RANK}, id) AS rn FROM v_contacts) WHERE rn = 1),
      owners AS (SELECT email, min(id) AS owner FROM v_contacts WHERE email <> '' GROUP BY email),
      outcome AS (SELECT *, {JSON_SCORE} AS new_score FROM (SELECT application_id,
          CASE WHEN json_valid(score_raw) THEN score_raw END AS score, CASE WHEN json_valid(validation_raw)
            THEN CAST(json_extract(CASE WHEN json_valid(validation_raw) THEN validation_raw END, '$.is_valid') AS BOOLEAN) END AS valid_ok,
          CASE WHEN json_valid(message_raw) THEN message_raw END AS message,
          CASE WHEN json_valid(tailor_raw) THEN tailor_raw END AS tailor FROM v_answers)),
      facts AS (SELECT a.id, CAST(a.current_stage AS INTEGER) AS start, a.state AS old_state, a.score AS old_score, a.contact_id AS old_contact,
          j.company_id, c.name AS company_name, j.title AS job_title,
          rs.research_ok, o.valid_ok, o.message, o.tailor, g.draft_ok, o.new_score,
          NOT (o.new_score < CAST({RULES.minimum_score} AS DOUBLE)) AS passes,
          j.company_id IN (SELECT company_id FROM guarded) AS is_guarded,
          l.id AS linked_id, l.name AS linked_name, l.email AS linked_email,
          b.id AS best_id, b.name AS best_name, b.email AS best_email,
          {DOMAIN.replace('domain', 'c.domain').replace('(name)', '(c.name)')} AS domain,
          m.application_id IS NOT NULL AS mailed, m.id AS mail_id, m.created_at AS mail_day, m.status AS mail_status,
          a.id IN (SELECT application_id FROM v_resume_versions) AS resumed
        FROM {applications} a JOIN v_jobs j ON a.job_id = j.id JOIN v_companies c ON j.company_id = c.id
        LEFT JOIN outcome o ON o.application_id = a.id LEFT JOIN v_signals g ON g.application_id = a.id
        LEFT JOIN researched rs ON rs.company_id = c.id
        LEFT JOIN v_contacts l ON l.id = a.contact_id LEFT JOIN best b ON b.company_id = j.company_id
        LEFT JOIN latest_mail m ON m.application_id = a.id
        WHERE {MOVABLE.format(closed=_in(closed)).replace('state', 'a.state', 1)} AND {where}),
      chosen AS (SELECT *,
          CASE WHEN linked_id IS NOT NULL THEN linked_id WHEN start <= 4 THEN best_id END AS contact_key,
          CASE WHEN linked_id IS NOT NULL THEN linked_name WHEN start <= 4 THEN coalesce(best_name, 'Hiring Manager') END AS contact_name,
          CASE WHEN linked_id IS NOT NULL THEN linked_email WHEN start <= 4 THEN best_email END AS contact_mail FROM facts),
      known AS (SELECT k.*, coalesce(contact_mail, '') <> '' AS known,
          start <= 5 OR contact_mail IS NOT NULL AS addressed,
          start <= 8 OR mailed AS has_mail, start <= 7 OR resumed AS has_resume, {_strip('x.answer')} AS answer
        FROM chosen k LEFT JOIN mailboxes x ON x.contact_id = k.contact_key),
      guessed AS (SELECT k.*, CASE WHEN start <= 5 AND NOT known AND contact_name IS NOT NULL THEN
          CASE WHEN regexp_matches(answer, '{MAILBOX}') AND lower(split_part(answer, '@', 2)) IN (SELECT domain FROM v_mx WHERE accepts_mail) THEN answer
               WHEN domain IN (SELECT domain FROM v_mx WHERE accepts_mail) THEN
          list_filter({_guesses('contact_name', 'domain')}, lambda g: regexp_matches(g, '{MAILBOX}'))[1] END END AS guess FROM known k),
      owned AS (SELECT d.*, o.owner, CASE WHEN known THEN contact_mail ELSE guess END AS mailbox, start <= 4 AND linked_id IS NULL AS open
        FROM guessed d LEFT JOIN owners o ON o.email = d.guess),
      alone AS (SELECT *, {end0} AS end0, {state0} AS state0 FROM (SELECT *, {stop} AS stop0 FROM owned)),
      cand AS (SELECT row_number() OVER (ORDER BY id) AS n, id, company_id, nullif(mailbox, '') AS mailbox, open FROM alone
        WHERE start <= {max_stage} AND (state0 IN {_in(CONTACTED)} OR (start <= 10 AND end0 > 10))),
      walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS companies, CAST([] AS VARCHAR[]) AS mails, CAST([] AS BIGINT[]) AS won
        UNION ALL SELECT c.n, {grown('companies', 'company_id')}, {grown('mails', 'mailbox')}, {grown('won', 'id')}
        FROM walk w JOIN cand c ON c.n = w.n + 1),
      winners AS (SELECT * FROM cand WHERE id IN (SELECT unnest(won) FROM (SELECT won FROM walk ORDER BY n DESC LIMIT 1))),
      by_company AS (SELECT company_id, min(id) AS first FROM winners GROUP BY 1),
      by_mailbox AS (SELECT mailbox, min(id) AS first FROM winners WHERE mailbox IS NOT NULL GROUP BY 1),
      stopped AS (SELECT a.*, CASE WHEN {max_stage} >= 4 AND open AND (bc.first < a.id OR bm.first < a.id) AND coalesce(stop0 >= 4, true) THEN 4 ELSE stop0 END AS stop
        FROM alone a LEFT JOIN by_company bc ON bc.company_id = a.company_id LEFT JOIN by_mailbox bm ON bm.mailbox = a.mailbox),
      ended AS (SELECT *, {end} AS endstage, {state} AS end_state FROM stopped),
      judged AS (SELECT *, start <= 4 AND endstage > 4 AND linked_id IS NULL AS picked,
          start <= 5 AND endstage > 5 AND NOT known AS resolved FROM ended),
      made AS (SELECT company_id, (SELECT max(id) FROM v_contacts) + row_number() OVER (ORDER BY min(id)) AS made_id, min(company_name) AS company_name
        FROM judged WHERE picked AND contact_key IS NULL GROUP BY company_id),
      held AS (SELECT j.*, CASE WHEN picked AND contact_key IS NULL THEN m.made_id ELSE contact_key END AS own_contact
        FROM judged j LEFT JOIN made m USING (company_id)),
      setters AS (SELECT guess, arg_min(own_contact, id) AS setter, min(id) AS setter_id FROM held WHERE resolved AND owner IS NULL GROUP BY guess),
      final AS (SELECT h.*, s.setter, s.setter_id, CASE WHEN resolved THEN coalesce(owner, s.setter, own_contact)
          WHEN picked THEN own_contact ELSE old_contact END AS final_contact FROM held h LEFT JOIN setters s ON s.guess = h.guess),
      result AS (SELECT id, start AS old_stage, old_state, CAST(endstage AS INTEGER) AS current_stage, end_state AS state,
          final_contact AS contact_id,
          CASE WHEN resolved THEN guess WHEN picked THEN contact_mail ELSE linked_email END AS contact_email,
          CASE WHEN start <= 6 AND passes IS NOT NULL AND (endstage > 6 OR stop = 6) THEN new_score ELSE old_score END AS score
        FROM final)"""


def _resting(columns: str) -> str:
    return f"SELECT {columns} FROM v_applications WHERE NOT ({MOVABLE.format(closed=_in(RUN_TERMINAL))})"


def _gate_run(m: int) -> str:
    return f"""SELECT {m} AS max_stage, id, current_stage, state FROM (WITH {_judged(m)} SELECT * FROM result)
      UNION ALL {_resting(f'{m}, id, CAST(current_stage AS INTEGER), state')}"""


RESUME_PATH = "'out/resume_' || replace(lower(company_name), ' ', '_') || '_' || replace(lower(job_title), ' ', '_') || '_' || CAST(id AS VARCHAR) || '/base.typ'"
DRAFT_ID = "'draft-' || CAST(id AS VARCHAR)"


def _history() -> str:
    """Logged transitions: a success row per passed stage, then the failure row."""
    ok = {4: "linked_id IS NULL", 5: "NOT known AND NOT coalesce(owner IS NULL AND setter = own_contact AND setter_id < id, false)"}
    no = {9: "has_mail AND has_resume", 10: "NOT (contact_name IS NOT NULL AND NOT has_mail)"}
    passed = {3: "'company researched'", 4: "'contact: ' || contact_name", 5: "'mailbox: ' || mailbox", 6: "'scored high enough'",
              7: f"'resume: ' || {RESUME_PATH}", 8: "'message written'", 9: "'validated'", 10: f"'draft: ' || {DRAFT_ID}", 11: "'all stages done'"}
    failed = {3: "'nothing found on the company'", 4: "'company or mailbox already written to'",
              5: "CASE WHEN contact_name IS NULL THEN 'no contact' ELSE 'no mailbox for ' || contact_name END",
              6: "CASE WHEN passes IS NULL THEN 'no score' ELSE 'score below the threshold' END", 7: "'resume not tailored'",
              8: "'no contact'", 9: "'message rejected'", 10: "'no draft made'", 11: "'not finalized'"}
    arms = []
    for s in range(3, 12):
        arms.append(f"SELECT id, {s} * 2 AS ord, {s + 1} AS stage, '{STATE_ON_ENTRY[s + 1]}' AS state, {passed[s]} AS notes FROM final "
                    f"WHERE start <= {s} AND endstage > {s} AND ({ok.get(s, 'true')})")
        arms.append(f"SELECT id, {s} * 2 + 1, {s}, end_state, {failed[s]} FROM final WHERE stop = {s} AND ({no.get(s, 'true')})")
    return " UNION ALL ".join(arms)


def _audit() -> str:
    view = {"runs": "v_runs", "cache_entries": "v_cache"}
    parts = [f"""SELECT 'unique {t}.{c}' AS constraint_name, count(*) AS violations FROM
        (SELECT {c} FROM {view.get(t, 'v_' + t)} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)"""
             for t, c in audit.UNIQUE]
    parts += [f"""SELECT 'reference {t}.{c}', count(*) FROM {view.get(t, 'v_' + t)} x
        WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {view.get(p, 'v_' + p)})"""
              for t, c, p in audit.REFERENCES]
    return " UNION ALL ".join(parts)


_ORDERS_DAY = f"CAST('{ORDERS_AS_OF}' AS TIMESTAMP)"
AGE = f"date_diff('second', updated_at, {_ORDERS_DAY})"
AGE_TEXT = f"""CASE WHEN {AGE} < 60 THEN 'Just now' WHEN {AGE} < 3600 THEN CAST({AGE} // 60 AS VARCHAR) || 'm ago'
      WHEN {AGE} < 86400 THEN CAST({AGE} // 3600 AS VARCHAR) || 'h ago' ELSE CAST({AGE} // 86400 AS VARCHAR) || 'd ago' END"""
TODAY = f"""(SELECT count(*) FROM v_emails WHERE status = 'draft_created' AND created_at >= {_ORDERS_DAY}
      AND created_at < {_ORDERS_DAY} + INTERVAL 1 DAY)"""
MAIL_FIRST = "coalesce(nullif(ct.email, ''), 'N/A')"
_SIGN = signature(RULES)
LOGGED = f"'RUN-19980615-001' AS run_id, '{ORDERS_AS_OF}' AS timestamp"
_LIMIT = RULES.daily_draft_limit

_RAW: dict[str, str] = {
    "scan_entities": f"""SELECT * REPLACE ({_time('updated_at')} AS updated_at, CAST(contact_id AS VARCHAR) AS contact_id)
        FROM v_applications""",
    "log_tail": """SELECT id, application_id, CAST(stage AS INTEGER) AS stage, state, run_id, trim(notes) AS line
        FROM v_history ORDER BY timestamp DESC, id DESC LIMIT 150""",
    "evolve_emails": f"""SELECT id, application_id, status,
        CASE WHEN status = 'draft_created' THEN {_time('created_at')} END AS scheduled_at FROM v_emails""",
    "integrity_audit": _audit(),
    "filter_company_exclusion": f"SELECT id, name FROM v_companies c WHERE NOT {EXCLUDED}",
    "filter_title_keyword": f"SELECT id, title FROM v_jobs j WHERE NOT {TITLE}",
    "filter_experience": f"SELECT id, experience_years_required FROM v_jobs j WHERE NOT ({YEARS})",
    "filter_cascade": f"""SELECT j.id AS job_id, j.company_id,
        CASE WHEN {EXCLUDED} OR {TITLE} OR {YEARS} THEN 2 ELSE 3 END AS current_stage,
        CASE WHEN {EXCLUDED} THEN 'Excluded Company' WHEN {TITLE} OR {YEARS} THEN 'Ghost Job' ELSE 'Company Research' END AS state,
        CASE WHEN {EXCLUDED} THEN 'excluded company: ' || c.name WHEN {TITLE} THEN 'excluded word in title: ' || j.title
             WHEN {YEARS} THEN 'needs ' || CAST(j.experience_years_required AS VARCHAR) || ' years, limit 1.0'
             ELSE 'passed screening' END AS note
        FROM v_jobs j JOIN v_companies c ON j.company_id = c.id""",
    "refilter_existing": f"""WITH openings AS (SELECT id, company_id, title, experience_years_required FROM v_jobs
          UNION ALL SELECT id, company_id, title, experience_years_required FROM v_postings)
        SELECT job_id, CAST(id AS VARCHAR) AS application_id, CAST(current_stage AS INTEGER) AS current_stage, state, false AS is_new, NULL AS note
        FROM v_applications WHERE state NOT IN {_in(REFILTER_CLOSED)}
        UNION ALL SELECT j.id, NULL, CASE WHEN {EXCLUDED} OR {TITLE} OR {YEARS} THEN 2 ELSE 3 END,
          CASE WHEN {EXCLUDED} THEN 'Excluded Company' WHEN {TITLE} OR {YEARS} THEN 'Ghost Job' ELSE 'Company Research' END, true,
          CASE WHEN {EXCLUDED} THEN 'excluded company: ' || c.name WHEN {TITLE} THEN 'excluded word in title: ' || j.title
             WHEN {YEARS} THEN 'needs ' || CAST(j.experience_years_required AS VARCHAR) || ' years, limit 1.0'
             ELSE 'passed screening' END
        FROM openings j JOIN v_companies c ON j.company_id = c.id
        WHERE j.id NOT IN (SELECT job_id FROM v_applications)""",
    "resume_selection": f"""SELECT id, CAST(current_stage AS INTEGER) AS current_stage, state FROM v_applications
        WHERE state NOT IN {_in(RUN_TERMINAL)}""",
    "drafts_today": f"SELECT {TODAY} AS drafts_today",
    "domain_denylist": f"""WITH {DENIED} SELECT page_id, {_host('url')} AS domain,
        contains({_host('url')}, 'spam-farm') OR contains({_host('url')}, 'blog.') AS is_block_heavy
        FROM pages WHERE {_host('url')} NOT IN (SELECT domain FROM denied)""",
    "exclusion_carveout": """SELECT id, array_to_string(list_filter(['00000007', 'customer#00000001', 'Labs'],
        lambda x: NOT contains(lower(name), lower(x))), ',') AS kept FROM v_companies""",
    "normalize_url": f"SELECT id, {URL} AS url FROM v_jobs",
    "active_applications": f"""SELECT a.id, a.run_id, c.name AS company_name, j.title AS job_title, a.current_stage,
        {_label()} AS stage_name, CAST(floor(a.current_stage / 12.0 * 100) AS INTEGER) AS stage_percent, a.state,
        {_time('a.updated_at')} AS updated_at, {AGE_TEXT} AS updated_ago,
        CASE WHEN a.score <> 0 THEN round(a.score, 2) END AS score
        FROM v_applications a JOIN v_jobs j ON a.job_id = j.id JOIN v_companies c ON j.company_id = c.id
        WHERE a.state NOT IN {_in(WEB_TERMINAL)}""",
    "application_list": f"""SELECT a.id, a.run_id, c.name AS company_name, j.title AS job_title, a.current_stage,
        {_label()} AS stage_name, a.state, round(a.score, 2) AS score, {MAIL_FIRST} AS contact_email,
        coalesce(a.tailored_resume_path, 'N/A') AS resume_path,
        coalesce(regexp_extract(a.tailored_resume_path, '[^/]*$'), 'N/A') AS resume_file, {_time('a.updated_at')} AS updated_at
        FROM v_applications a JOIN v_jobs j ON a.job_id = j.id JOIN v_companies c ON j.company_id = c.id
        LEFT JOIN v_contacts ct ON a.contact_id = ct.id""",
    "company_list": """SELECT id, name, coalesce(nullif(domain, ''), 'N/A') AS domain,
        coalesce(CAST(nullif(employee_count, 0) AS VARCHAR), 'N/A') AS employee_count,
        coalesce(nullif(industry, ''), 'N/A') AS industry FROM v_companies ORDER BY name, id LIMIT 200""",
    "contact_list": f"""SELECT ct.id, c.name AS company_name, ct.name, ct.role, {MAIL_FIRST} AS email
        FROM v_contacts ct JOIN v_companies c ON ct.company_id = c.id ORDER BY ct.id DESC LIMIT 200""",
    "job_list": """SELECT j.id, c.name AS company_name, j.title, coalesce(nullif(j.url, ''), 'N/A') AS url
        FROM v_jobs j JOIN v_companies c ON j.company_id = c.id ORDER BY j.id DESC LIMIT 200""",
    "application_details": f"""WITH {LATEST_MAIL},
        latest_resume AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY id DESC) AS rn
          FROM v_resume_versions) WHERE rn = 1),
        seen AS (SELECT application_id, count(*) AS n, arg_max(state, id) AS last_event FROM
          (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY timestamp DESC, id DESC) AS rn FROM v_history) GROUP BY application_id),
        newest AS (SELECT application_id, state FROM (SELECT *, row_number() OVER (PARTITION BY application_id
          ORDER BY timestamp DESC, id DESC) AS rn FROM v_history) WHERE rn = 1)
        SELECT a.id, a.run_id, a.current_stage, {_label()} AS stage_name, a.state, round(a.score, 2) AS score,
          a.tailored_resume_path, j.title AS job_title, c.name AS company_name,
          coalesce(nullif(c.domain, ''), 'N/A') AS company_domain, coalesce(nullif(c.industry, ''), 'N/A') AS company_industry,
          coalesce(nullif(ct.name, ''), 'N/A') AS contact_name, coalesce(nullif(ct.role, ''), 'N/A') AS contact_role,
          {MAIL_FIRST} AS contact_email, m.subject AS email_subject, m.gmail_draft_id AS email_draft_id, m.status AS email_status,
          r.parent_resume, r.path AS resume_path, coalesce(h.n, 0) AS history_rows, n.state AS last_event
        FROM v_applications a JOIN v_jobs j ON a.job_id = j.id JOIN v_companies c ON j.company_id = c.id
        LEFT JOIN v_contacts ct ON a.contact_id = ct.id LEFT JOIN latest_mail m ON m.application_id = a.id
        LEFT JOIN latest_resume r ON r.application_id = a.id LEFT JOIN seen h ON h.application_id = a.id
        LEFT JOIN newest n ON n.application_id = a.id""",
    "company_upsert": """WITH wanted AS (SELECT name, min(ordinal) AS ordinal, arg_min(domain, ordinal) AS domain FROM v_found_companies GROUP BY name),
        stored AS (SELECT name, min(id) AS id FROM v_companies GROUP BY name)
        SELECT s.id, w.name, w.ordinal, false AS is_new, NULL AS domain FROM wanted w JOIN stored s USING (name)
        UNION ALL SELECT (SELECT max(id) FROM v_companies) + row_number() OVER (ORDER BY ordinal), name, ordinal, true, domain
        FROM wanted WHERE name NOT IN (SELECT name FROM stored)""",
    "job_upsert": f"""WITH found AS (SELECT id AS ordinal, {URL} AS url, company_id, title FROM v_jobs WHERE created_at >= TIMESTAMP '1998-01-01 00:00:00'),
        stored AS (SELECT url, min(id) AS id FROM (SELECT id, {URL} AS url FROM v_jobs WHERE created_at < TIMESTAMP '1998-01-01 00:00:00')
          WHERE url IS NOT NULL GROUP BY url),
        top AS (SELECT max(id) AS m FROM v_jobs WHERE created_at < TIMESTAMP '1998-01-01 00:00:00'),
        keyed AS (SELECT url, min(ordinal) AS ordinal, arg_min(company_id, ordinal) AS company_id, arg_min(title, ordinal) AS title
          FROM found WHERE url IS NOT NULL GROUP BY url),
        fresh AS (SELECT url, ordinal, company_id, title FROM keyed WHERE url NOT IN (SELECT url FROM stored)
          UNION ALL SELECT url, ordinal, company_id, title FROM found WHERE url IS NULL)
        SELECT s.id, k.url, k.ordinal, false AS is_new, NULL AS company_id, NULL AS title FROM keyed k JOIN stored s USING (url)
        UNION ALL SELECT (SELECT m FROM top) + row_number() OVER (ORDER BY ordinal), url, ordinal, true, company_id, title FROM fresh""",
    "contact_upsert": """WITH wanted AS (SELECT company_id, name, min(ordinal) AS ordinal, arg_min(role, ordinal) AS role FROM v_found_contacts GROUP BY company_id, name),
        stored AS (SELECT company_id, name, min(id) AS id FROM v_contacts GROUP BY company_id, name),
        both_sides AS (SELECT w.*, s.id FROM wanted w LEFT JOIN stored s ON w.company_id = s.company_id AND w.name = s.name)
        SELECT id, company_id, name, ordinal, false AS is_new, NULL AS role FROM both_sides WHERE id IS NOT NULL
        UNION ALL SELECT (SELECT max(id) FROM v_contacts) + row_number() OVER (ORDER BY ordinal), company_id, name, ordinal, true, role
        FROM both_sides WHERE id IS NULL""",
    "entity_match": """WITH by_name AS (SELECT lower(name) AS k, min(id) AS id FROM v_companies GROUP BY 1),
        by_domain AS (SELECT domain AS k, min(id) AS id FROM v_companies WHERE domain IS NOT NULL GROUP BY 1)
        SELECT t.target_id, CAST(coalesce(n.id, d.id) AS VARCHAR) AS company_id,
          CASE WHEN n.id IS NOT NULL THEN 'name' WHEN d.id IS NOT NULL THEN 'domain' ELSE 'new' END AS matched_by
        FROM v_targets t LEFT JOIN by_name n ON lower(t.name) = n.k LEFT JOIN by_domain d ON lower(t.domain) = d.k""",
    "duplicate_guard": f"""WITH {GUARD} SELECT a.id, j.company_id FROM v_applications a JOIN v_jobs j ON a.job_id = j.id
        WHERE j.company_id IN (SELECT company_id FROM guarded)""",
    "completed_semi": """SELECT id, state FROM v_applications WHERE state = 'Completed'
        OR id IN (SELECT application_id FROM v_emails WHERE gmail_draft_id IS NOT NULL)""",
    "email_conflict_relink": f"""WITH {FIRST_VALID},
        found AS (SELECT g.id AS contact_id, v.mailbox AS email FROM guessed g LEFT JOIN valid v USING (id) WHERE coalesce(g.email, '') = ''
          UNION ALL SELECT id, email FROM v_contacts WHERE email <> ''),
        other AS (SELECT f.contact_id, f.email, (SELECT min(o.id) FROM v_contacts o WHERE o.email = f.email AND o.id <> f.contact_id
          AND o.email <> '') AS owner FROM found f)
        SELECT contact_id, email, coalesce(owner, contact_id) AS linked_contact_id,
          CASE WHEN owner IS NOT NULL THEN 'relink' ELSE 'set' END AS action FROM other""",
    "mail_domain_join": f"""SELECT id, email, lower(split_part({_strip('email')}, '@', -1)) AS domain FROM v_contacts
        WHERE email <> '' AND lower(split_part({_strip('email')}, '@', -1)) IN (SELECT domain FROM v_mx WHERE accepts_mail)""",
    "export_pending": """SELECT id, state FROM v_applications WHERE id NOT IN
        (SELECT application_id FROM v_emails WHERE gmail_draft_id IS NOT NULL)""",
    "status_summary_web": f"""SELECT count(*) AS total,
        count(*) FILTER (WHERE state = 'Completed' OR id IN (SELECT application_id FROM v_emails WHERE gmail_draft_id IS NOT NULL)) AS completed,
        count(*) FILTER (WHERE state ILIKE '%failed%' OR state ILIKE '%error%') AS failed,
        count(*) FILTER (WHERE state IN {_in(WEB_FILTERED)}) AS filtered,
        count(*) FILTER (WHERE state NOT IN {_in(WEB_TERMINAL)} AND job_id IN
          (SELECT j.id FROM v_jobs j JOIN v_companies c ON j.company_id = c.id)) AS active
        FROM v_applications""",
    "status_summary_cli": f"""SELECT count(*) AS total, count(*) FILTER (WHERE state = 'Completed') AS completed,
        count(*) FILTER (WHERE state IN {_in(RETRYABLE)}) AS failed,
        count(*) FILTER (WHERE state IN {_in(CLI_FILTERED)}) AS filtered FROM v_applications""",
    "active_runs": "SELECT count(*) FILTER (WHERE status = 'running') AS active_runs FROM v_runs",
    "domain_stats": """SELECT domain, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures
        FROM v_fetch_log WHERE domain <> '' GROUP BY domain""",
    "domain_stats_merge": """WITH w AS (SELECT domain, count(*) AS n FROM v_fetch_log WHERE ok GROUP BY 1),
        l AS (SELECT domain, count(*) AS n FROM v_fetch_log WHERE NOT ok GROUP BY 1)
        SELECT coalesce(w.domain, l.domain) AS domain, coalesce(w.n, 0) AS successes, coalesce(l.n, 0) AS failures
        FROM w FULL JOIN l ON w.domain = l.domain""",
    "domain_blacklist": f"""SELECT domain FROM v_fetch_log GROUP BY domain
        HAVING count(*) FILTER (WHERE NOT ok) >= 5 AND count(*) FILTER (WHERE ok) = 0
        UNION SELECT * FROM (VALUES {", ".join(f"('{d}')" for d in SEED_BLOCKED_DOMAINS)}) s(domain)""",
    "domain_breaker": """SELECT id, domain, ok, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY run_day, domain
        ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3 AS disabled FROM v_fetch_log""",
    "next_run_id": """SELECT prefix, prefix || printf('%03d', max(n) + 1) AS next_id FROM
        (SELECT substr(id, 1, 13) AS prefix, CAST(substr(id, 14) AS BIGINT) AS n FROM v_runs) GROUP BY prefix""",
    "weighted_score": f"""SELECT application_id, round({SCORE}, 6) AS score,
        NOT (({SCORE}) < CAST({RULES.minimum_score} AS DOUBLE)) AS passes FROM v_scores""",
    "stage_funnel": """SELECT CAST(current_stage AS VARCHAR) AS current_stage, state, count(*) AS applications
        FROM v_applications GROUP BY ROLLUP (current_stage, state)""",
    "latest_email": """SELECT application_id, id, subject, gmail_draft_id, status FROM (SELECT *, row_number() OVER
        (PARTITION BY application_id ORDER BY id DESC) AS rn FROM v_emails) WHERE rn = 1""",
    "latest_resume": """SELECT application_id, id, path FROM (SELECT *, row_number() OVER
        (PARTITION BY application_id ORDER BY id DESC) AS rn FROM v_resume_versions) WHERE rn = 1""",
    "best_contact": f"""SELECT company_id, id, role, rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY rank, id) AS rn
        FROM (SELECT *, {RANK} AS rank FROM v_contacts)) WHERE rn = 1""",
    "first_valid_email": f"WITH {FIRST_FOUND} SELECT g.id, v.mailbox FROM guessed g LEFT JOIN valid v USING (id)",
    "first_seen_dedup": """SELECT name, ordinal, domain FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ordinal) AS rn
        FROM v_found_companies) WHERE rn = 1""",
    "recent_applications": """SELECT a.id, c.name AS company_name, j.title AS job_title, 'Stage ' || CAST(a.current_stage AS VARCHAR) AS stage,
        a.state, CASE WHEN a.score <> 0 THEN printf('%.2f', a.score) ELSE 'N/A' END AS score
        FROM (SELECT * FROM v_applications ORDER BY updated_at DESC, id LIMIT 10) a
        JOIN v_jobs j ON a.job_id = j.id JOIN v_companies c ON j.company_id = c.id""",
    "topn_hits": f"WITH {DENIED}, {_top_hits(3)} SELECT query_id, rank, pos, target, domain FROM top",
    "draft_quota": f"""WITH {_judged(12)},
        drafts AS (SELECT id, start <= 8 OR (mail_day >= {_ORDERS_DAY} AND mail_status <> 'draft_created') AS fresh
          FROM judged WHERE start <= 10 AND endstage > 10),
        counted AS (SELECT id, {TODAY} + (SELECT count(*) FROM drafts d WHERE d.fresh AND d.id < j.id) AS before
          FROM judged j WHERE start = 10),
        cut AS (SELECT min(id) AS break_id FROM counted WHERE before >= {_LIMIT}),
        strict AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM drafts)
        SELECT j.id, coalesce(j.id < (SELECT break_id FROM cut), true) AS admitted,
          s.id IS NULL OR s.n <= {_LIMIT} - {TODAY} AS within_cap
        FROM judged j LEFT JOIN strict s ON s.id = j.id""",
    "history_timeline": """SELECT application_id, CAST(stage AS INTEGER) AS stage, state,
        strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, notes, id FROM v_history""",
    "hits_union": f"""WITH {DENIED}, {_top_hits(2)} SELECT query_id, rank, target FROM top
        UNION ALL SELECT query_id, CAST(min(pos) AS INTEGER), target FROM
          (SELECT query_id, pos, {_decode("regexp_extract(href, '/RU=([^/]+)', 1)")} AS target FROM v_ru_hits)
          WHERE target <> '' AND NOT contains(target, 'engine.example.net') GROUP BY query_id, target""",
    "keywords_text": """SELECT id, CASE WHEN added_words IS NULL THEN 'software development' ELSE replace(added_words, ' ', ', ') END AS skills
        FROM v_keywords""",
    "email_syntax": f"SELECT id, {SOUND} AS sound FROM v_contacts",
    "email_verdict": f"WITH {VERDICTS} SELECT id, verdict FROM verdicts",
    "clean_domain": """SELECT page_id, CASE WHEN starts_with(lower(url), 'http://') OR starts_with(lower(url), 'https://')
        THEN split_part(split_part(lower(url), '//', -1), '/', 1) ELSE lower(url) END AS domain FROM pages""",
    "email_candidates": f"""WITH domains AS (SELECT id AS company_id, {DOMAIN} AS domain FROM v_companies)
        SELECT c.id, array_to_string({_guesses('c.name', 'd.domain')}, ',') AS guesses FROM v_contacts c JOIN domains d USING (company_id)""",
    "default_domain": f"SELECT id, {DOMAIN} AS domain FROM v_companies",
    "url_domain": f"SELECT page_id, {_host('url')} AS domain FROM pages",
    "slug_key": "SELECT id, 'speculative://' || replace(lower(name || ' ' || industry), ' ', '_') AS key FROM v_companies",
    "content_key": """SELECT doc_id, 'pasted://' || replace(lower(source), ' ', '_') || '_' || substr(md5(text), 1, 8) AS key
        FROM documents""",
    "mailbox_name": """SELECT id, CASE email WHEN 'bad-email' THEN 'Bad-Email' ELSE array_to_string(list_transform(
        string_split(split_part(email, '@', 1), '.'), lambda w: upper(w[1]) || lower(w[2:])), '.') END AS name FROM v_contacts""",
    "relative_age": f"SELECT id, {AGE_TEXT} AS age FROM v_applications",
    "score_round": """SELECT id, CASE WHEN score / 3 <> 0 THEN round(score / 3, 2) END AS listed, round(score / 3, 2) AS detailed
        FROM v_applications""",
    "body_preview": """SELECT doc_id, CASE WHEN text <> '' THEN substr(text, 1, 300) || '...' END AS preview FROM documents""",
    "page_text": f"SELECT page_id, {_page_text('html')} AS text FROM v_pages",
    "page_text_parsed": f"SELECT page_id, {_page_text('html')} AS text FROM v_pages",
    "chunk_assembly": f"""WITH {DENIED}, {_top_hits(3)},
        texts AS (SELECT url AS page_url, {_page_text('html')} AS text FROM v_pages)
        SELECT query_id, string_agg(chr(10) || '--- ' || domain || ' (' || target || ') ---' || chr(10) || substr(text, 1, 2000), '' ORDER BY rank) AS evidence,
          count(*) AS hits FROM top JOIN texts ON target = page_url GROUP BY query_id""",
    "clean_redirect": f"""SELECT pos, CASE WHEN starts_with(t, '//') THEN 'https:' || t ELSE t END AS target
        FROM (SELECT pos, {REDIRECT} AS t FROM v_hits)""",
    "clean_redirect_ru": f"""SELECT query_id, target, min(pos) AS pos FROM
        (SELECT query_id, pos, {_decode("regexp_extract(href, '/RU=([^/]+)', 1)")} AS target FROM v_ru_hits)
        WHERE target <> '' AND NOT contains(target, 'engine.example.net') GROUP BY query_id, target""",
    "extract_links": f"""WITH found AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a\\s*>', 1) AS h,
          regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a\\s*>', 2) AS l FROM v_pages),
        rows AS (SELECT page_id, unnest(h) AS h, unnest(l) AS l, generate_subscripts(h, 1) AS i FROM found)
        SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, {_entities('h', True)} AS href,
          {_strip(_entities(f"regexp_replace(l, '{TAG}', '', 'g')"))} AS title FROM rows""",
    "search_results": f"""WITH {DENIED},
        blocks AS (SELECT query_id, unnest(string_split_regex(html, '<div class="(?:links )?result__body">')[2:]) AS b,
            generate_subscripts(string_split_regex(html, '<div class="(?:links )?result__body">')[2:], 1) AS i FROM v_first_pages),
        one AS (SELECT query_id, i, regexp_extract(b, '<a class="result__url" href="([^"]*)">(.*?)</a>', 1) AS h,
            regexp_extract(b, '<a class="result__url" href="([^"]*)">(.*?)</a>', 2) AS title, regexp_extract(b, '<a class="result__snippet"[^>]*>(.*?)</a>', 1) AS snippet
          FROM blocks WHERE contains(b, 'result__snippet')),
        two AS (SELECT query_id, i, title, snippet, {_entities('h', True)} AS href FROM one),
        three AS (SELECT query_id, i, title, snippet, CASE WHEN starts_with(t, '//') THEN 'https:' || t ELSE t END AS url FROM (SELECT *, {REDIRECT} AS t FROM two)),
        first AS (SELECT query_id, i, title, url, snippet FROM three WHERE {_host('url')} NOT IN (SELECT domain FROM denied)),
        pieces AS (SELECT query_id, unnest(string_split(html, '<a ')[2:]) AS p, generate_subscripts(string_split(html, '<a ')[2:], 1) AS i
          FROM v_second_pages WHERE query_id NOT IN (SELECT query_id FROM first)),
        other AS (SELECT query_id, i, {_decode("regexp_extract(p, '/RU=([^/]+)', 1)")} AS url, regexp_replace(regexp_extract(p, '>(.*?)</(?:h3|div)>', 1), '<[^>]*>', '', 'g') AS title,
            regexp_extract(p, '</div><p>(.*?)</p>', 1) AS snippet FROM pieces),
        second AS (SELECT query_id, min(i) AS i, arg_min(title, i) AS title, url, arg_min(snippet, i) AS snippet FROM other
          WHERE NOT contains(url, 'engine.example.net') GROUP BY query_id, url),
        hits AS (SELECT query_id, i, title, url, snippet FROM first
          UNION ALL SELECT query_id, i, coalesce(nullif(title, ''), url), url, snippet FROM second WHERE {_host('url')} NOT IN (SELECT domain FROM denied)),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INTEGER) AS pos FROM hits)
        SELECT query_id, pos, {_strip(_entities("regexp_replace(title, '<[^>]*>', '', 'g')"))} AS title, url, {_strip(_entities('snippet'))} AS snippet FROM ranked WHERE pos < 3
        UNION ALL SELECT query_id, 0, 'Search result for ' || query, 'https://example.com/search?q=' || replace(replace(query, ' ', '+'), '&', '%26'),
          'Stand-in result for: ' || query FROM v_queries WHERE query_id NOT IN (SELECT query_id FROM hits)""",
    "log_scan": """WITH kept AS (SELECT line, json_valid(line) AND NOT contains(line, '"many"') AS sound FROM v_log_lines WHERE trim(line) <> ''),
        j AS (SELECT CAST(line AS JSON) AS j FROM kept WHERE sound)
        SELECT 'row' AS channel, json_extract_string(j, '$.level') AS level, json_extract_string(j, '$.message') AS message,
          json_extract_string(j, '$.run_id') AS run_id, json_extract_string(j, '$.stage') AS stage, CAST(json_extract(j, '$.duration_seconds') AS DOUBLE) AS duration_seconds,
          json_extract_string(j, '$.retries') AS retries, NULL AS line FROM j
        UNION ALL SELECT 'reject', NULL, NULL, NULL, NULL, NULL, NULL, line FROM kept WHERE NOT sound""",
    "export_incremental": f"""WITH early AS (SELECT *, CASE WHEN updated_at < TIMESTAMP '{EXPORT_DAY}' THEN 0 ELSE 1 END AS pass FROM v_applications)
        SELECT CAST(a.pass AS BIGINT) AS pass, count(*) AS new, CAST(sum(count(*)) OVER (ORDER BY a.pass) AS BIGINT) AS total, count(*) AS records, min(a.id) AS first,
          count(*) FILTER (WHERE c.email <> '') AS with_mailbox, CAST(sum(count(*)) OVER () AS BIGINT) AS cumulative
        FROM early a LEFT JOIN v_contacts c ON c.id = a.contact_id GROUP BY a.pass""",
    "stream_export": """SELECT a.state AS application_state, count(*) AS exported, count(DISTINCT a.id) AS applications, max(coalesce(c.name, 'N/A')) AS last_company
        FROM v_applications a LEFT JOIN v_jobs j ON a.job_id = j.id LEFT JOIN v_companies c ON j.company_id = c.id GROUP BY a.state""",
    "fence_strip": f"SELECT id, {UNFENCED} AS body FROM v_responses",
    "response_parse": f"""SELECT id, CAST(json_extract(body, '$.k') AS INTEGER) AS k FROM (SELECT id, {UNFENCED} AS body FROM v_responses)
        WHERE json_valid(body)""",
    "response_rejects": f"""SELECT id, raw FROM (SELECT id, raw, {UNFENCED} AS body FROM v_responses) WHERE NOT json_valid(body)""",
    "json_or_raw": """SELECT id, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.k') END AS k,
        CASE WHEN NOT json_valid(raw) THEN raw END AS plain FROM v_responses""",
    "response_explode": """WITH sound AS (SELECT company_id, CAST(raw AS JSON) AS j FROM v_job_responses WHERE json_valid(raw)),
        rows AS (SELECT company_id, p AS pos, json_extract(j, '$.jobs[' || p || ']') AS e FROM sound, (VALUES (0), (1)) n(p))
        SELECT company_id, pos, json_extract_string(e, '$.title') AS title, nullif(trim(json_extract_string(e, '$.url')), '') AS url,
          json_extract_string(e, '$.location') AS location,
          TRY_CAST(json_extract_string(e, '$.experience_years') AS DOUBLE) AS experience_years FROM rows""",
    "template_render": """SELECT ct.id, 'Hello ' || ct.name || ', the ' || lower(ct.role) || ' opening at ' || c.name
          || ' fits my work on ' || CASE WHEN ct.email <> '' THEN c.industry ELSE 'modern tools' END || '.' AS message
        FROM v_contacts ct JOIN v_companies c ON ct.company_id = c.id""",
    "message_fallback": f"""SELECT id, json_valid(body) AS accepted,
        CASE WHEN json_valid(body) THEN CAST(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.k') AS INTEGER) ELSE CAST(length(raw) AS INTEGER) END AS k
        FROM (SELECT id, raw, {UNFENCED} AS body FROM v_responses)""",
    "signature_inject": f"""SELECT id, CASE WHEN contains(body, '{RULES.linkedin_url}') OR contains(body, '{RULES.github_url}') THEN body
        WHEN contains(body, 'Jane Doe') THEN substr(body, 1, instr(body, 'Jane Doe') + 7) || '{_SIGN}' || substr(body, instr(body, 'Jane Doe') + 8)
        ELSE body || '<p>{_SIGN}</p>' END AS body FROM v_messages""",
    "placeholder_check": """WITH found AS (SELECT id, list_filter([
          CASE WHEN regexp_matches(body, '(?i)\\[(?:insert|your|candidate|my|company|contact|name|role|date)\\b[^\\]]*\\]') THEN 'bracket placeholder' END,
          CASE WHEN regexp_matches(body, '(?i)<(?:company|name|role|contact|date)>') THEN 'tag placeholder' END,
          CASE WHEN regexp_matches(body, '\\{[a-z_]+\\}') THEN 'brace placeholder' END,
          CASE WHEN regexp_matches(body, '\\bYYYY\\b') THEN 'date placeholder' END], lambda e: e IS NOT NULL) AS errors FROM v_messages)
        SELECT id, len(errors) = 0 AS is_valid, array_to_string(errors, ', ') AS errors FROM found""",
    "unsupported_keywords": """WITH words AS (SELECT id, unnest(list_distinct(string_split(added_words, ' '))) AS w, base_words, added_words FROM v_keywords
          WHERE added_words IS NOT NULL),
        bad AS (SELECT id, string_agg(w, ',' ORDER BY instr(' ' || added_words || ' ', ' ' || w || ' ')) AS u FROM words
          WHERE NOT contains(' ' || base_words || ' ', ' ' || w || ' ') GROUP BY id)
        SELECT k.id, coalesce(u, '') AS unsupported FROM v_keywords k LEFT JOIN bad USING (id)""",
    "structured_generate": """SELECT id, true AS accepted, CAST(length(state || ' of ' || run_id) AS INTEGER) AS k FROM v_history""",
    "application_advance": f"""WITH {_judged(12)} SELECT * REPLACE (round(score, 6) AS score, CAST(contact_id AS VARCHAR) AS contact_id) FROM result UNION ALL
        {_resting("id, CAST(current_stage AS INTEGER), state, CAST(current_stage AS INTEGER), state, CAST(contact_id AS VARCHAR), NULL, round(score, 6)")}""",
    "history_emit": f"""WITH {_judged(12)} SELECT id AS application_id,
          CAST(row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS INTEGER) AS step, stage, state, {LOGGED}, notes FROM ({_history()})""",
    "advance_contacts": f"""WITH {_judged(12)}, found AS (SELECT own_contact AS id, arg_min(guess, id) AS email FROM final
          WHERE resolved AND owner IS NULL AND setter = own_contact GROUP BY own_contact)
        SELECT c.id, c.company_id, c.name, c.role, coalesce(f.email, c.email) AS email,
          CASE WHEN f.email IS NOT NULL THEN 'found' ELSE 'stored' END AS origin FROM v_contacts c LEFT JOIN found f USING (id)
        UNION ALL SELECT m.made_id, m.company_id, 'Hiring Manager', 'Engineering Manager', f.email, 'made' FROM made m LEFT JOIN found f ON f.id = m.made_id""",
    "advance_emails": f"""WITH {_judged(12)}, texts AS (SELECT *, start <= 10 AND endstage > 10 AS drafted,
          coalesce(json_extract_string(message, '$.subject'), 'Application to ' || company_name) AS subject,
          coalesce(json_extract_string(message, '$.body_html'), '<p>Hello ' || coalesce(contact_name, '') || ',</p><p>I would like to join '
            || company_name || ' as ' || job_title || '.</p><p>Jane Doe</p>') AS body FROM final)
        SELECT (SELECT max(id) FROM v_emails) + row_number() OVER (ORDER BY id) AS id, id AS application_id, subject,
          CASE WHEN contains(body, 'Jane Doe') THEN substr(body, 1, instr(body, 'Jane Doe') + 7) || '{_SIGN}' || substr(body, instr(body, 'Jane Doe') + 8)
            ELSE body || '<p>{_SIGN}</p>' END AS body, CASE WHEN drafted THEN {DRAFT_ID} END AS gmail_draft_id,
          CASE WHEN drafted THEN 'draft_created' ELSE 'generated' END AS status, '{ORDERS_AS_OF}' AS created_at, 'written' AS origin
        FROM texts WHERE start <= 8 AND endstage > 8
        UNION ALL SELECT e.id, e.application_id, e.subject, e.body, coalesce('draft-' || CAST(t.id AS VARCHAR), e.gmail_draft_id),
          CASE WHEN t.id IS NOT NULL THEN 'draft_created' ELSE e.status END, {_time('e.created_at')},
          CASE WHEN t.id IS NOT NULL THEN 'drafted' ELSE 'stored' END
        FROM v_emails e LEFT JOIN (SELECT * FROM texts WHERE drafted AND start > 8) t ON t.mail_id = e.id""",
    "advance_resumes": f"""WITH {_judged(12)}
        SELECT (SELECT max(id) FROM v_resume_versions) + row_number() OVER (ORDER BY id) AS id, id AS application_id, 'base.typ' AS parent_resume,
          {RESUME_PATH} AS path, '{ORDERS_AS_OF}' AS created_at, coalesce(array_to_string(CAST(json_extract_string(tailor, '$.keywords_added[*]') AS VARCHAR[]), ','), '') AS keywords,
          coalesce(json_extract_string(tailor, '$.reasoning'), 'base resume kept') AS reasoning, 'tailored' AS origin FROM final WHERE start <= 7 AND endstage > 7
        UNION ALL SELECT id, application_id, parent_resume, path, {_time('created_at')}, NULL, NULL, 'stored' FROM v_resume_versions""",
    "research_outcomes": f"""WITH {RESEARCH} SELECT company_id, research_ok,
        CASE WHEN hit THEN 'cache' WHEN research_ok THEN 'answer' ELSE 'none' END AS origin FROM researched""",
    "research_cached": f"""WITH {RESEARCH}, new AS (SELECT 'company_research_' || lower(c.name) AS key, a.raw AS value,
          TIMESTAMP '{ORDERS_AS_OF}' + to_seconds({RULES.cache_ttl_seconds}) AS expires_at
          FROM researched r JOIN v_companies c ON c.id = r.company_id JOIN v_research_answers a ON a.company_id = c.id WHERE research_ok AND NOT hit)
        SELECT key, value, {_time('expires_at')} AS expires_at FROM new
        UNION ALL SELECT key, value, {_time('expires_at')} FROM kept WHERE key NOT IN (SELECT key FROM new)""",
    "retry_log": f"""SELECT id AS application_id, CASE state WHEN 'Research Failed' THEN 3 WHEN 'Draft Failed' THEN 10 ELSE 7 END AS stage,
        CASE state WHEN 'Research Failed' THEN 'Company Research' WHEN 'Draft Failed' THEN 'Gmail Draft Creation' ELSE 'Resume Tailoring' END AS state,
        {LOGGED}, 'retry after ' || state AS notes FROM v_applications WHERE state IN {_in(RETRYABLE)}""",
    "screening_log": f"""WITH openings AS (SELECT id, company_id, title, experience_years_required FROM v_jobs
          UNION ALL SELECT id, company_id, title, experience_years_required FROM v_postings),
        entered AS (SELECT j.id AS job_id, {EXCLUDED} OR {TITLE} OR {YEARS} AS out,
          CASE WHEN {EXCLUDED} THEN 'Excluded Company' ELSE 'Ghost Job' END AS state,
          CASE WHEN {EXCLUDED} THEN 'excluded company: ' || c.name WHEN {TITLE} THEN 'excluded word in title: ' || j.title
             WHEN {YEARS} THEN 'needs ' || CAST(j.experience_years_required AS VARCHAR) || ' years, limit 1.0' END AS note
          FROM openings j JOIN v_companies c ON j.company_id = c.id WHERE j.id NOT IN (SELECT job_id FROM v_applications))
        SELECT job_id, 0 AS step, 2 AS stage, CASE WHEN out THEN state ELSE 'Filtering' END AS state, {LOGGED},
          CASE WHEN out THEN note ELSE 'entered' END AS notes FROM entered
        UNION ALL SELECT job_id, 1, 3, 'Company Research', {LOGGED}, 'passed screening' FROM entered WHERE NOT out""",
    "stage_gate": " UNION ALL ".join(_gate_run(m) for m in (2, 5, 7, 10, 12)),
    "retry_reset": f"""SELECT id, CAST(CASE state WHEN 'Research Failed' THEN 3 WHEN 'Draft Failed' THEN 10 WHEN 'Validation Failed' THEN 7
          WHEN 'Failed' THEN 7 ELSE current_stage END AS INTEGER) AS current_stage,
        CASE state WHEN 'Research Failed' THEN 'Company Research' WHEN 'Draft Failed' THEN 'Gmail Draft Creation'
          WHEN 'Validation Failed' THEN 'Resume Tailoring' WHEN 'Failed' THEN 'Resume Tailoring' ELSE state END AS state,
        CASE WHEN state IN {_in(RETRYABLE)} THEN 'retry after ' || state END AS note FROM v_applications""",
    "state_override": f"""WITH fixes AS (SELECT application_id, {_case('state', OVERRIDES)} AS state,
          row_number() OVER (PARTITION BY application_id ORDER BY id DESC) AS rn FROM v_history WHERE {_case('state', OVERRIDES)} IS NOT NULL)
        SELECT a.id, CAST(a.current_stage AS INTEGER) AS current_stage, coalesce(f.state, a.state) AS state,
          CASE WHEN f.state IS NOT NULL THEN '{ORDERS_AS_OF}' ELSE {_time('a.updated_at')} END AS updated_at
        FROM v_applications a LEFT JOIN (SELECT * FROM fixes WHERE rn = 1) f ON f.application_id = a.id""",
    "speculative_jobs": f"""SELECT id AS company_id, 'Backend Engineer (Speculative Application)' AS title,
        'speculative://' || replace(lower(name), ' ', '_') AS url, 'Remote' AS location, CAST(1.0 AS DOUBLE) AS experience_years_required
        FROM (SELECT id, name FROM v_companies UNION ALL SELECT id, name FROM v_prospects)
        WHERE id NOT IN (SELECT company_id FROM v_jobs j WHERE NOT {TITLE} AND NOT ({YEARS}))""",
    "placeholder_contacts": """SELECT id AS company_id, 'Hiring Manager' AS name, 'Engineering Manager' AS role,
        'https://linkedin.com/company/' || lower(name) AS linkedin_url
        FROM v_companies WHERE id NOT IN (SELECT company_id FROM v_contacts)""",
    "discovery_run": f"""WITH wanted AS (SELECT name, min(ordinal) AS ordinal FROM v_found_companies GROUP BY name),
        known AS (SELECT c.id, w.name, w.ordinal FROM wanted w JOIN v_companies c ON c.name = w.name
          UNION ALL SELECT (SELECT max(id) FROM v_companies) + row_number() OVER (ORDER BY ordinal), name, ordinal
          FROM wanted WHERE name NOT IN (SELECT name FROM v_companies)),
        answers AS (SELECT company_id, CAST(raw AS JSON) AS j FROM v_job_responses WHERE json_valid(raw)),
        answered AS (SELECT a.company_id, k.ordinal * 1048576 + p AS ordinal, json_extract(j, '$.jobs[' || p || ']') AS e
          FROM answers a JOIN known k ON k.id = a.company_id, (VALUES (0), (1)) n(p)),
        found AS (SELECT company_id, ordinal, json_extract_string(e, '$.title') AS title,
            nullif(trim(json_extract_string(e, '$.url')), '') AS url,
            TRY_CAST(json_extract_string(e, '$.experience_years') AS DOUBLE) AS years FROM answered
          UNION ALL SELECT id, ordinal * 1048576, 'Backend Engineer (Speculative Application)',
            'speculative://' || replace(lower(name), ' ', '_'), 1.0 FROM known WHERE id NOT IN (SELECT company_id FROM answered)),
        fresh AS (SELECT * FROM found WHERE url IS NULL
          UNION ALL SELECT f.* FROM found f JOIN (SELECT url, min(ordinal) AS o FROM found WHERE url IS NOT NULL GROUP BY url) u
            ON f.url = u.url AND f.ordinal = u.o),
        numbered AS (SELECT (SELECT max(id) FROM v_jobs) + row_number() OVER (ORDER BY ordinal) AS job_id, * FROM fresh)
        SELECT job_id, CASE WHEN note = 'passed screening' THEN 3 ELSE 2 END AS current_stage,
          CASE WHEN note = 'passed screening' THEN 'Company Research' WHEN starts_with(note, 'excluded company') THEN 'Excluded Company'
               ELSE 'Ghost Job' END AS state, true AS is_new, company_id, title, url, note
        FROM (SELECT n.*, CASE WHEN contains(lower(k.name), '00000007') THEN 'excluded company: ' || k.name
            WHEN contains(lower(title), 'specified') THEN 'excluded word in title: ' || title
            WHEN coalesce(years, 0) > 1.0 THEN 'needs ' || CAST(years AS VARCHAR) || ' years, limit 1.0'
            ELSE 'passed screening' END AS note FROM numbered n JOIN known k ON k.id = n.company_id)""",
    "targeted_advance": f"""WITH RECURSIVE linked_apps AS (SELECT a.* REPLACE (CASE WHEN c.industry = 'MACHINERY' AND a.state NOT IN {_in(REFILTER_CLOSED)}
            THEN 4 ELSE a.contact_id END AS contact_id)
          FROM v_applications a JOIN v_jobs j ON a.job_id = j.id JOIN v_companies c ON j.company_id = c.id),
        {_judged(12, REFILTER_CLOSED, 'linked_apps', "c.industry = 'MACHINERY'").replace('FROM v_applications WHERE state IN', 'FROM linked_apps WHERE state IN').removeprefix('RECURSIVE ')}
        SELECT * REPLACE (round(score, 6) AS score, CAST(contact_id AS VARCHAR) AS contact_id) FROM result""",
    "cache_lookup": f"""WITH {ENTRIES}, {REQUESTS} SELECT request_id, r.key, e.key IS NOT NULL AS hit, e.value FROM requests r
        LEFT JOIN (SELECT * FROM entries WHERE {LIVE}) e ON e.key = r.key""",
    "cache_upsert": f"WITH {ENTRIES} SELECT key, version, value, {_time('expires_at')} AS expires_at FROM entries",
    "cache_clear_expired": f"WITH {ENTRIES} SELECT count(*) FILTER (WHERE NOT ({LIVE})) AS expired, count(*) AS entries FROM entries",
    "cache_miss_plan": f"""WITH {ENTRIES}, {REQUESTS}, asked AS (SELECT DISTINCT key FROM requests)
        SELECT a.key, coalesce(e.value, 'made:' || a.key) AS value, CASE WHEN e.key IS NULL THEN 'computed' ELSE 'cache' END AS origin
        FROM asked a LEFT JOIN (SELECT * FROM entries WHERE {LIVE}) e ON e.key = a.key""",
    "clean_contacts": f"""WITH {VERDICTS} SELECT id, CASE WHEN verdict IN ('syntax', 'domain') THEN NULL ELSE email END AS email,
        verdict IN ('syntax', 'domain') AS cleared FROM verdicts""",
    "clean_applications": f"""WITH {VERDICTS}, joined AS (SELECT a.id, a.state, coalesce(verdict IN ('syntax', 'domain'), false)
            AND a.state IN {_in(CLEARED_EMAIL_STATES)} AS lost,
          a.state IN {_in(NO_EMAIL_STATES)} AND coalesce(verdict, '') <> 'ok' AS stuck
          FROM v_applications a LEFT JOIN verdicts v ON v.id = a.contact_id)
        SELECT id, CASE WHEN lost OR stuck THEN 'No Professional Email' ELSE state END AS state, lost OR stuck AS changed FROM joined""",
    "clean_summary": f"""WITH {VERDICTS} SELECT (SELECT count(*) FROM verdicts WHERE verdict IN ('syntax', 'domain')) AS cleared_emails,
        count(*) AS updated_applications FROM v_applications a LEFT JOIN verdicts v ON v.id = a.contact_id
        WHERE (coalesce(verdict IN ('syntax', 'domain'), false) AND a.state IN {_in(CLEARED_EMAIL_STATES)})
          OR (a.state IN {_in(NO_EMAIL_STATES)} AND coalesce(verdict, '') <> 'ok')""",
    "export_record": f"""WITH {LATEST_MAIL} SELECT a.id AS application_id, a.run_id, coalesce(c.name, 'N/A') AS company_name,
        CASE WHEN c.id IS NULL THEN 'N/A' ELSE c.domain END AS company_domain, CASE WHEN c.id IS NULL THEN 'N/A' ELSE c.industry END AS company_industry,
        CASE WHEN c.id IS NULL THEN 'N/A' ELSE CAST(c.employee_count AS VARCHAR) END AS company_employee_count,
        CASE WHEN j.id IS NULL THEN 'N/A' ELSE j.title END AS job_title, CASE WHEN j.id IS NULL THEN 'N/A' END AS job_location,
        CASE WHEN j.id IS NULL THEN 'N/A' ELSE CAST(j.salary_lpa AS VARCHAR) END AS job_salary,
        coalesce(ct.name, 'N/A') AS contact_name, coalesce(ct.role, 'N/A') AS contact_role, {MAIL_FIRST} AS contact_email,
        coalesce(m.subject, 'N/A') AS email_subject, coalesce(substr(m.body, 1, 300) || '...', 'N/A') AS email_body_preview,
        coalesce(m.gmail_draft_id, 'N/A') AS gmail_draft_id, a.state AS application_state, a.current_stage,
        CASE WHEN a.score <> 0 THEN round(a.score, 2) END AS score, {_time('a.updated_at')} AS updated_at
        FROM v_applications a LEFT JOIN v_jobs j ON a.job_id = j.id LEFT JOIN v_companies c ON j.company_id = c.id
        LEFT JOIN v_contacts ct ON a.contact_id = ct.id LEFT JOIN latest_mail m ON m.application_id = a.id""",
    "current_state": """SELECT application_id, state, CAST(stage AS INTEGER) AS stage FROM (SELECT *, row_number() OVER
        (PARTITION BY application_id ORDER BY timestamp DESC, id DESC) AS rn FROM v_history) WHERE rn = 1""",
    "transition_counts": f"""SELECT {_time("date_trunc('hour', timestamp)")} AS window_start, state, count(*) AS transitions
        FROM v_history GROUP BY 1, 2""",
}
_RAW["stream_current_state"] = _RAW["current_state"]
_RAW["stream_transition_counts"] = _RAW["transition_counts"]
_RAW["stream_breaker"] = """SELECT CAST(run_day AS VARCHAR) AS run_day, domain, count(*) AS failures, count(*) >= 3 AS disabled
    FROM v_fetch_log WHERE NOT ok AND domain <> '' GROUP BY run_day, domain"""


def _arrived(hours: int, deliveries: str = "v_arrivals") -> str:
    """Events that are not behind the watermark, ``hours`` before the latest event of the slices before their own;
    ``reached``: the watermark after the last slice."""
    bounds = [f"TIMESTAMP '{end}'" for end in SLICES]
    number = "CASE " + " ".join(f"WHEN arrival < {b} THEN {i}" for i, b in enumerate(bounds)) + " END"
    mark = f"date_trunc('millisecond', max(ts)) - INTERVAL {hours} HOUR"
    return f"""sliced AS (SELECT *, {number} AS slice FROM {deliveries}),
      marks AS (SELECT s.slice, (SELECT {mark} FROM sliced e WHERE e.slice < s.slice) AS mark FROM (SELECT DISTINCT slice FROM sliced) s),
      reached AS (SELECT {mark} AS reached FROM sliced),
      arrived AS (SELECT s.* FROM sliced s JOIN marks m USING (slice) WHERE m.mark IS NULL OR s.ts > m.mark)"""


# A repeat counts if no delivery of an earlier slice, or of its own, is still known.
_RAW["stream_dedup"] = f"""WITH {_arrived(DEDUP_HOURS, 'v_deliveries')},
    kept AS (SELECT DISTINCT r.event_id, r.slice FROM arrived r LEFT JOIN marks m USING (slice) WHERE NOT EXISTS
      (SELECT 1 FROM arrived e WHERE e.event_id = r.event_id AND e.slice < r.slice AND e.ts + INTERVAL {DEDUP_HOURS} HOUR > m.mark))
    SELECT event_id AS id, count(*) AS deliveries FROM kept GROUP BY event_id"""

# Lifetimes by gaps-and-islands: a write begins one if the write before it had expired. Those that ended before the
# last watermark have left the cache.
_RAW["stream_ttl"] = f"""WITH {_arrived(1)},
    writes AS (SELECT *, created_at + {_TTL} AS e FROM v_cache WHERE version IN (SELECT event_id FROM arrived)),
    marked AS (SELECT *, coalesce(created_at > lag(e) OVER w, true) AS opens FROM writes WINDOW w AS (PARTITION BY key ORDER BY created_at, version)),
    islands AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY created_at, version) AS island FROM marked),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key, island ORDER BY created_at DESC, version DESC) AS back,
      min(created_at) OVER (PARTITION BY key, island) AS s, count(*) OVER (PARTITION BY key, island) AS writes FROM islands)
    SELECT key, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS first_write, strftime(e, '%Y-%m-%d %H:%M:%S.%f') AS expired_at, value, writes
    FROM ranked, reached WHERE back = 1 AND e < reached"""

CHECKS: dict[str, str] = {name: with_prelude(body) for name, body in _RAW.items()}
