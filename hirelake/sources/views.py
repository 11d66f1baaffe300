"""Fixture views: the entity tables as projections of the generated test tables.

The same text runs in Spark and in the SQL used to check results; only the table names differ,
so both sides always see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared, so that no query starts with a schema inference job.
BASE_TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment "
        "STRING"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
        "p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity "
        "DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
        "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
        "props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

EVENTS_AS_OF = "2024-01-15 00:00:00"
ORDERS_AS_OF = "1998-06-15 00:00:00"

# Escapes the characters that occur in the page addresses.
_ENCODED_URL = (
    "replace(replace(replace(replace(replace(replace(url, ':', '%3A'), '/', '%2F'), '?', '%3F'), "
    "'&', '%26'), '=', '%3D'), '#', '%23')"
)
_FENCE = "chr(96) || chr(96) || chr(96)"

VIEWS: dict[str, str] = {
    "v_companies": """
        SELECT c_custkey AS id, c_name AS name,
               CASE WHEN c_custkey % 5 = 0 THEN NULL
                    ELSE 'c' || CAST(c_custkey AS VARCHAR(20)) || '.example.com' END AS domain,
               CAST(floor(abs(c_acctbal)) AS BIGINT) AS employee_count, c_mktsegment AS industry
        FROM {customer}""",
    "v_jobs": """
        SELECT o_orderkey AS id, o_custkey AS company_id, o_orderpriority AS title,
               CASE WHEN o_orderkey % 11 = 0 THEN '   '
                    WHEN o_orderkey % 13 = 0 THEN NULL
                    ELSE ' http://jobs.example.com/' || CAST(o_custkey AS VARCHAR(20)) || '/' || o_orderstatus
                    END AS url,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE (o_orderkey % 5) * CAST(0.5 AS DOUBLE) END AS experience_years_required,
               o_totalprice AS salary_lpa, o_orderdate AS created_at
        FROM {orders}""",
    # Openings that nobody applied to yet.
    "v_postings": """
        SELECT 1000000000 + p_partkey AS id, CAST(floor(p_partkey / 3) AS BIGINT) AS company_id, p_type || ' Engineer' AS title,
               'http://jobs.example.com/p/' || CAST(p_partkey AS VARCHAR(20)) AS url,
               CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_size % 5) * CAST(0.5 AS DOUBLE) END AS experience_years_required
        FROM {part}""",
    # Companies of another list: suppliers, none of which has a job.
    "v_prospects": """
        SELECT 1000000000 + s_suppkey AS id, s_name AS name FROM {supplier}""",
    "v_contacts": """
        SELECT p_partkey AS id, CAST(floor(p_partkey / 3) AS BIGINT) AS company_id, p_name AS name,
               p_type AS role,
               CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'bad-email'
                    WHEN 3 THEN replace(p_name, ' ', '.') || '@c' || CAST(p_partkey % 100 AS VARCHAR(20)) || '.example.com'
                    ELSE 'x' || CAST(p_partkey AS VARCHAR(20)) || '@c' || CAST(p_partkey AS VARCHAR(20)) || '.example.com'
                    END AS email
        FROM {part}""",
    "v_mx": """
        SELECT 'c' || CAST(c_custkey AS VARCHAR(20)) || '.example.com' AS domain, c_custkey % 3 <> 0 AS accepts_mail
        FROM {customer}""",
    "v_applications": """
        SELECT o_orderkey AS id, 'RUN-' || CAST(o_orderkey % 9 AS VARCHAR(20)) AS run_id,
               o_orderkey AS job_id,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 200 END AS contact_id,
               o_orderkey % 13 AS current_stage,
               CASE o_orderkey % 24
                 WHEN 0 THEN 'Company Discovery' WHEN 1 THEN 'Filtering' WHEN 2 THEN 'Company Research'
                 WHEN 3 THEN 'Contact Research' WHEN 4 THEN 'Professional Email Discovery'
                 WHEN 5 THEN 'Opportunity Scoring' WHEN 6 THEN 'Resume Tailoring'
                 WHEN 7 THEN 'Email Generation' WHEN 8 THEN 'Validation'
                 WHEN 9 THEN 'Gmail Draft Creation' WHEN 10 THEN 'Database Finalization'
                 WHEN 11 THEN 'Completed' WHEN 12 THEN 'Skipped' WHEN 13 THEN 'Duplicate'
                 WHEN 14 THEN 'Salary Too Low' WHEN 15 THEN 'Excluded Company' WHEN 16 THEN 'Ghost Job'
                 WHEN 17 THEN 'No Professional Email' WHEN 18 THEN 'Research Failed'
                 WHEN 19 THEN 'Timeout' WHEN 20 THEN 'Validation Failed' WHEN 21 THEN 'Draft Failed'
                 WHEN 22 THEN 'Manual Skip' ELSE 'Failed' END AS state,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 10) / CAST(10 AS DOUBLE) END AS score,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL
                    ELSE 'out/r' || CAST(o_orderkey AS VARCHAR(20)) || '/base.pdf' END AS tailored_resume_path,
               o_orderdate AS updated_at
        FROM {orders}""",
    "v_emails": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS application_id,
               'Subject ' || CAST(l_linenumber AS VARCHAR(20)) AS subject,
               '<p>Hi ' || max(l_linestatus) || '</p>' AS body,
               CASE WHEN max(l_returnflag) = 'A' THEN 'd' || CAST(l_orderkey AS VARCHAR(20)) ELSE NULL END AS gmail_draft_id,
               CASE WHEN max(l_returnflag) = 'A' THEN 'draft_created' ELSE 'generated' END AS status,
               max(l_shipdate) AS created_at
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "v_resume_versions": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS application_id,
               max(l_shipdate) AS created_at, 'base.typ' AS parent_resume,
               'out/r' || CAST(l_orderkey AS VARCHAR(20)) || '/base.pdf' AS path
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "v_history": """
        SELECT event_id AS id, user_id AS application_id, event_id % 13 AS stage, event_type AS state,
               'RUN-' || CAST(user_id % 9 AS VARCHAR(20)) AS run_id, ts AS timestamp, props AS notes
        FROM {events}""",
    # One run per event, so that the run reports grow with the data; suffixes pass 999.
    "v_runs": """
        SELECT 'RUN-' || replace(CAST(CAST(ts AS DATE) AS VARCHAR(10)), '-', '') || '-'
                 || printf('%03d', event_id % 1100 + 1) AS id,
               CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END AS status
        FROM {events}""",
    "v_cache": """
        SELECT event_type || ':' || CAST(user_id AS VARCHAR(20)) AS key, event_id AS version,
               props AS value, ts AS created_at,
               CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 7 = 0 THEN CAST(event_id % 3 - 1 AS BIGINT)
                    ELSE CAST(floor(value * 3600) AS BIGINT) END AS ttl_seconds
        FROM {events}""",
    # Events as they arrive: most at once, some long after they happened.
    "v_arrivals": """
        SELECT *, ts + CASE WHEN event_id % 11 = 0 THEN INTERVAL '8' DAY ELSE INTERVAL '0' DAY END AS arrival FROM {events}""",
    # Deliveries of events: some again a day later, some again much later, some long after they happened.
    "v_deliveries": """
        SELECT event_id, ts, user_id, event_type, value, props,
               ts + CASE WHEN event_id % 11 = 0 THEN INTERVAL '8' DAY ELSE INTERVAL '0' DAY END AS arrival FROM {events}
        UNION ALL
        SELECT event_id, ts + INTERVAL '1' DAY, user_id, event_type, value, props, ts + INTERVAL '1' DAY FROM {events}
        WHERE event_id % 5 = 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0
        UNION ALL
        SELECT event_id, ts + INTERVAL '12' DAY, user_id, event_type, value, props, ts + INTERVAL '12' DAY FROM {events}
        WHERE event_id % 7 = 0 AND event_id % 11 <> 0""",
    "v_fetch_log": """
        SELECT event_id AS id, 'd' || CAST(user_id AS VARCHAR(20)) || '.example.com' AS domain,
               CAST(ts AS DATE) AS run_day, ts, (event_type <> 'error' AND user_id % 7 <> 0) AS ok
        FROM {events}""",
    # Pages with references that lack a semicolon or a known name, in texts and in links.
    "v_pages": """
        SELECT page_id, url, html || '<p>&copy2024 &notit; &alpha beta &eacute;t&eacute;</p><a href="/next?x=1&lang=en&order=2&sub=3&page='
               || CAST(page_id AS VARCHAR(20)) || '&amp;copy=1&copy=2&not">more &copy2024 &amp;lt;</a>' AS html
        FROM {pages}""",
    # Result pages of two engines, one query for each page; some have no results, some only denied ones.
    "v_queries": """
        SELECT page_id AS query_id, 'find ' || CAST(page_id AS VARCHAR(20)) || ' & more' AS query FROM {pages}""",
    "v_first_pages": f"""
        SELECT page_id AS query_id, '<html><div class="results">' || CASE WHEN page_id % 5 = 0 THEN '<p>No results</p>' ELSE
               '<div class="links result__body"><a class="result__url" href="//engine.example.net/l/?uddg=' || {_ENCODED_URL} || '&amp;rut=1">One &amp; <b>'
               || CAST(page_id AS VARCHAR(20)) || '</b></a><a class="result__snippet" href="#">About &eacute;t&eacute;</a></div>'
               || '<div class="result__body"><a class="result__url" href="https://b.example.org/?a=1&copy=2">Two</a></div>'
               || CASE WHEN page_id % 4 = 0 THEN '' ELSE '<div class="result__body"><a class="result__url" href="https://c' || CAST(page_id % 7 AS VARCHAR(20))
               || '.example.org/x?a=1&lang=2">Three</a><a class="result__snippet">third</a></div><div class="result__body"><a class="result__url" href="//d.example.org/">Four</a>'
               || '<a class="result__snippet">fourth</a></div><div class="result__body"><a class="result__url" href="//e.example.org/">Five</a><a class="result__snippet">fifth</a></div>' END END
               || '</div></html>' AS html
        FROM {{pages}}""",
    "v_second_pages": f"""
        SELECT page_id AS query_id, '<html><body>' || CASE WHEN page_id % 10 = 0 THEN '' ELSE
               '<div><h3 class="t"><a href="https://r.engine.example.net/_x=1/RU=' || {_ENCODED_URL} || '/RK=2/RS=a">Head <b>' || CAST(page_id AS VARCHAR(20))
               || '</b></a></h3></div><p>first &amp; snippet</p><div><a href="https://r.engine.example.net/_x=1/RU=' || {_ENCODED_URL} || '/RK=2/RS=b">again</a></div><p>twice</p>'
               || '<div><a href="https://r.engine.example.net/_x=1/RU=https%3A%2F%2Fengine.example.net%2Fads/RK=2">own</a></div><p>ad</p>'
               || '<div><a href="https://r.engine.example.net/_x=1/RU=https%3A%2F%2Fg.example.org%2F/RK=2"></a></div><p>untitled</p>' END || '</body></html>' AS html
        FROM {{pages}}""",
    # Log lines: whole ones, ones without most fields, ones broken off, ones of a wrong type, other text, blank ones.
    "v_log_lines": """
        SELECT event_id AS line_number, CASE event_id % 8
                 WHEN 0 THEN '{{"level": "INFO", "message": "' || event_type || '"}}'
                 WHEN 1 THEN '{{"level": "INFO", "message": "' || event_type || '", "run_id": "RUN-'
                 WHEN 2 THEN 'Traceback: ' || event_type
                 WHEN 3 THEN '{{"level": "INFO", "message": "m", "retries": "many"}}'
                 WHEN 4 THEN '  '
                 WHEN 5 THEN '{{"level": "INFO"}} {{"level": "WARN"}}'
                 ELSE '{{"timestamp": "2024-01-01T00:00:00Z", "level": "ERROR", "message": "' || event_type || '", "logger": "l", "run_id": "RUN-'
                   || CAST(user_id AS VARCHAR(20)) || '", "stage": "Stage 3", "duration_seconds": 1.5, "retries": ' || CAST(event_id % 4 AS VARCHAR(20)) || '}}' END AS line
        FROM {events}""",
    # Applications as a queue delivers them: some twice.
    "v_application_deliveries": """
        SELECT *, o_orderdate AS arrival FROM {orders}
        UNION ALL SELECT *, o_orderdate + INTERVAL '700' DAY AS arrival FROM {orders} WHERE o_orderkey % 10 = 0""",
    "v_hits": f"""
        SELECT page_id % 10 AS query_id, page_id AS pos, url,
               CASE page_id % 3 WHEN 0 THEN '//engine.example.net/l/?uddg='
                    WHEN 1 THEN '/l/?uddg=' ELSE 'https://engine.example.net/l/?uddg=' END
               || {_ENCODED_URL} || '&rut=' || CAST(page_id AS VARCHAR(20)) AS href
        FROM {{pages}}""",
    # The second engine's redirect form; every page is listed for two neighbouring queries.
    "v_ru_hits": f"""
        SELECT page_id % 10 AS query_id, page_id AS pos,
               'https://r.engine.example.net/_x=1/RU=' || CASE WHEN page_id % 8 = 0
                 THEN 'https%3A%2F%2Fengine.example.net%2Fads' ELSE {_ENCODED_URL} END || '/RK=2/RS=a' AS href
        FROM {{pages}}
        UNION ALL
        SELECT page_id % 10 AS query_id, page_id + 1000000000 AS pos,
               'https://r.engine.example.net/_x=2/RU=' || {_ENCODED_URL} || '/RK=2/RS=b' AS href
        FROM {{pages}}""",
    "v_responses": f"""
        SELECT event_id AS id,
               CASE event_id % 4
                 WHEN 0 THEN 'Sure: ' || {_FENCE} || 'json' || chr(10) || props || chr(10) || {_FENCE} || ' done'
                 WHEN 1 THEN props
                 WHEN 2 THEN substr(props, 1, length(props) - 1)
                 ELSE {_FENCE} || chr(10) || props || chr(10) || {_FENCE} END AS raw
        FROM {{events}}""",
    # Nested response: a list of jobs per company, with blank, repeated and missing urls.
    "v_job_responses": """
        SELECT c_custkey AS company_id,
               '{{"jobs": [' || '{{"title": "' || c_mktsegment || ' Engineer", "url": "https://c' || CAST(c_custkey % 50 AS VARCHAR(20))
               || '.example.com/a", "location": null, "salary": null, "experience_years": ' || CASE WHEN c_nationkey % 2 = 0 THEN '1.5' ELSE 'null' END
               || ', "description": "d"}}, ' || '{{"title": "Analyst", "url": "  ", "location": "Remote", "salary": "9 LPA", "experience_years": "2", "description": null}}'
               || CASE WHEN c_nationkey = 3 THEN '' ELSE ']}}' END AS raw
        FROM {customer}""",
    "v_scores": """
        SELECT o_orderkey AS application_id, (o_orderkey % 11) / CAST(10 AS DOUBLE) AS role_match,
               (o_orderkey % 9) / CAST(8 AS DOUBLE) AS tech_stack,
               (o_orderkey % 5) / CAST(4 AS DOUBLE) AS salary,
               (o_orderkey % 3) / CAST(2 AS DOUBLE) AS company_quality,
               (o_orderkey % 2) / CAST(1 AS DOUBLE) AS growth,
               (o_orderkey % 7) / CAST(6 AS DOUBLE) AS confidence
        FROM {orders}""",
    # Outcomes of the mail service.
    "v_signals": """
        SELECT o_orderkey AS application_id, o_orderkey % 29 <> 0 AS draft_ok
        FROM {orders}""",
    # Answers of a model to the questions of a run, some broken off.
    "v_answers": """
        SELECT o_orderkey AS application_id,
               '{{"role_match": ' || CAST((o_orderkey % 11) / CAST(10 AS DOUBLE) AS VARCHAR(30))
               || ', "tech_stack": ' || CAST((o_orderkey % 9) / CAST(8 AS DOUBLE) AS VARCHAR(30))
               || ', "salary": ' || CAST((o_orderkey % 5) / CAST(4 AS DOUBLE) AS VARCHAR(30))
               || ', "company_quality": ' || CAST((o_orderkey % 3) / CAST(2 AS DOUBLE) AS VARCHAR(30))
               || ', "growth": ' || CAST((o_orderkey % 2) / CAST(1 AS DOUBLE) AS VARCHAR(30))
               || ', "confidence": ' || CAST((o_orderkey % 7) / CAST(6 AS DOUBLE) AS VARCHAR(30))
               || ', "reasoning": "' || o_orderpriority || '"' || CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE '}}' END AS score_raw,
               '{{"tailored_typst_content": "t", "keywords_added": ["Spark", "' || o_orderpriority || '"], "reasoning": "fits '
               || o_orderstatus || CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE '"}}' END AS tailor_raw,
               '{{"subject": "Opening ' || CAST(o_orderkey AS VARCHAR(20)) || '", "body_html": "<p>Dear team</p>'
               || CASE WHEN o_orderkey % 4 = 0 THEN '<p>Jane Doe</p>' ELSE '' END || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '"}}' END AS message_raw,
               '{{"is_valid": ' || CASE WHEN o_orderkey % 23 = 0 THEN 'false' ELSE 'true' END || ', "errors": []'
               || CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE '}}' END AS validation_raw
        FROM {orders}""",
    "v_research_answers": """
        SELECT c_custkey AS company_id, '{{"business_model": "' || c_mktsegment || '", "funding": "none", "tech_stack": ["Spark", "SQL"], '
               || '"culture": "calm", "leadership": []' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '}}' END AS raw
        FROM {customer}""",
    # Addresses found for contacts: of other domains, shared between companies, unusable, none.
    "v_mailbox_answers": """
        SELECT p_partkey AS contact_id, '{{"email": ' || CASE p_partkey % 7 WHEN 0 THEN 'null'
                 WHEN 2 THEN '"x' || CAST(p_partkey AS VARCHAR(20)) || '@c3.example.com"' WHEN 3 THEN '"none found"'
                 WHEN 4 THEN '"found' || CAST(p_partkey AS VARCHAR(20)) || '@c7.example.com"'
                 ELSE '"shared' || CAST(CAST(floor(p_partkey / 60) AS BIGINT) AS VARCHAR(20)) || '@c5.example.com"' END
               || ', "pattern_used": null' || CASE WHEN p_partkey % 7 = 5 THEN '' ELSE '}}' END AS raw
        FROM {part}""",
    # What earlier runs cached: live, over, ending just now, empty.
    "v_run_cache": """
        SELECT 'company_research_' || lower(c_name) AS key, c_custkey AS version,
               CASE WHEN c_custkey % 4 = 3 THEN '{{}}' ELSE '{{"funding": "cached"}}' END AS value,
               CASE c_custkey % 4 WHEN 1 THEN CAST('1998-06-14 09:00:00' AS TIMESTAMP_NTZ) WHEN 2 THEN CAST('1998-06-15 00:00:00' AS TIMESTAMP_NTZ)
                    ELSE CAST('1998-06-16 09:00:00' AS TIMESTAMP_NTZ) END AS expires_at
        FROM {customer}
        UNION ALL
        SELECT 'email_customer#' || printf('%09d', CAST(floor(p_partkey / 3) AS BIGINT)) || '_' || replace(lower(p_name), ' ', '_') AS key,
               p_partkey AS version, 'cached' || CAST(p_partkey AS VARCHAR(20)) || '@c8.example.com' AS value,
               CASE WHEN p_partkey % 6 = 0 THEN CAST('1998-06-16 09:00:00' AS TIMESTAMP_NTZ)
                    ELSE CAST('1998-06-14 09:00:00' AS TIMESTAMP_NTZ) END AS expires_at
        FROM {part}""",
    # Discovered companies, in discovery order, with many repeats of the same name.
    "v_found_companies": """
        SELECT o_orderkey AS ordinal,
               'Customer#' || printf('%09d', o_custkey) || CASE WHEN o_orderstatus = 'F' THEN ' Labs' ELSE '' END AS name,
               'f' || CAST(o_custkey AS VARCHAR(20)) || '.example.org' AS domain
        FROM {orders}""",
    # Discovered contacts: some names are stored already, some are new.
    "v_found_contacts": """
        SELECT p_partkey AS ordinal, CAST(floor(p_partkey / 3) AS BIGINT) AS company_id,
               CASE WHEN p_type = 'PROMO' THEN p_name || ' jr' WHEN p_type = 'LARGE' THEN 'Pat Doe' ELSE p_name END AS name,
               p_type AS role
        FROM {part}""",
    # Target lines to match to companies by name, else by domain.
    "v_targets": """
        SELECT o_orderkey AS target_id,
               CASE o_orderstatus WHEN 'O' THEN 'CUSTOMER#' || printf('%09d', o_custkey)
                    ELSE 'Unlisted ' || CAST(o_custkey AS VARCHAR(20)) END AS name,
               CASE o_orderstatus WHEN 'P' THEN NULL
                    ELSE 'C' || CAST(o_custkey AS VARCHAR(20)) || '.EXAMPLE.COM' END AS domain
        FROM {orders}""",
    "v_keywords": """
        SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN NULL ELSE p_name END AS added_words,
               lower(p_type) || ' ring widget bolt' AS base_words
        FROM {part}""",
    # Outgoing messages: whole texts, some opening with an unfilled placeholder.
    "v_messages": """
        SELECT doc_id AS id, lang,
               CASE lang WHEN 'fr' THEN 'Hi [Insert Name], ' WHEN 'de' THEN '<p>Dear <Company> team</p>'
                    WHEN 'es' THEN 'Best regards, Jane Doe. Jane Doe ' ELSE 'In YYYY we met. ' END || text
               || CASE WHEN source = 'src1' THEN ' https://github.com/jane-doe' ELSE '' END AS body
        FROM {documents}""",
}


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(BASE_TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def _source_tables(name: str) -> list[str]:
    return [t for t in BASE_TABLES if "{" + t + "}" in VIEWS[name]]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view over the parquet tables of ``sf_dir``."""
    return spark.sql(VIEWS[name], **{t: base(spark, sf_dir, t) for t in _source_tables(name)})


def view_stream(spark: SparkSession, sf_dir: str, name: str, table: str, files: str | None = None) -> DataFrame:
    """A fixture view over a stream of the parquet files of one table, or of ``files``; times become instants."""
    # Written as a glob: a stream source takes a single file only that way; folders match as well.
    pattern = files or f"{sf_dir}/{table[:-1]}[{table[-1]}].parquet"
    stream = spark.readStream.schema(BASE_TABLES[table]).parquet(pattern)
    rows = spark.sql(VIEWS[name], **{table: stream})
    return rows.select(*[F.col(f.name).cast("timestamp") if f.dataType.typeName() == "timestamp_ntz"
                         else F.col(f.name) for f in rows.schema.fields])


# Arrivals come together up to each of these moments.
SLICES = ("2024-01-13 00:00:00", "2024-01-25 00:00:00", "2024-12-31 00:00:00")


def arrivals(spark: SparkSession, sf_dir: str, name: str = "v_arrivals") -> list[DataFrame]:
    """Arriving events in slices by time of arrival, each with the events table's own columns."""
    rows = view(spark, sf_dir, name)
    made, start = [], None
    for end in SLICES:
        own = F.col("arrival") < F.lit(end).cast("timestamp_ntz")
        if start is not None:
            own &= F.col("arrival") >= F.lit(start).cast("timestamp_ntz")
        made.append(rows.where(own).drop("arrival"))
        start = end
    return made


def with_prelude(body: str) -> str:
    """Prefix a SQL body with the view definitions it mentions, as common table expressions."""
    names = {t: t for t in BASE_TABLES}
    used = [f"{v} AS ({sql.format(**names).replace('TIMESTAMP_NTZ', 'TIMESTAMP')})" for v, sql in VIEWS.items() if v in body]
    body = body.strip()
    start = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    if body.upper().startswith("WITH "):
        return start + ",\n".join([*used, body[5:].removeprefix("RECURSIVE ")])
    return start + ",\n".join(used) + "\n" + body if used else body
