"""Explicit schemas: stored entities, the structured log, and typed model responses."""

from __future__ import annotations

from pyspark.sql import types as T


# Kept as DDL text, so that importing this module needs no running session.
ENTITIES: dict[str, str] = {
    "runs": ("id STRING, started_at TIMESTAMP, completed_at TIMESTAMP, status STRING"),
    "companies": (
        "id BIGINT, name STRING, domain STRING, employee_count INT, industry STRING, "
        "research_data STRUCT<business_model: STRING, funding: STRING, tech_stack: ARRAY<STRING>, "
        "culture: STRING, leadership: ARRAY<STRING>>, created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "jobs": (
        "id BIGINT, company_id BIGINT, title STRING, url STRING, salary STRING, "
        "salary_min_lpa DOUBLE, salary_max_lpa DOUBLE, experience_years_required DOUBLE, "
        "description STRING, location STRING, created_at TIMESTAMP"
    ),
    "contacts": (
        "id BIGINT, company_id BIGINT, name STRING, role STRING, email STRING, "
        "linkedin_url STRING, created_at TIMESTAMP"
    ),
    "applications": (
        "id BIGINT, run_id STRING, job_id BIGINT, contact_id BIGINT, current_stage INT, "
        "state STRING, score DOUBLE, score_breakdown STRING, tailored_resume_path STRING, "
        "created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "emails": (
        "id BIGINT, application_id BIGINT, subject STRING, body STRING, gmail_draft_id STRING, "
        "status STRING, scheduled_at TIMESTAMP, created_at TIMESTAMP"
    ),
    "resume_versions": (
        "id BIGINT, application_id BIGINT, parent_resume STRING, company STRING, role STRING, "
        "keywords_added ARRAY<STRING>, reasoning STRING, path STRING, created_at TIMESTAMP"
    ),
    "history": (
        "id BIGINT, application_id BIGINT, stage INT, state STRING, run_id STRING, "
        "timestamp TIMESTAMP, notes STRING"
    ),
    "cache_entries": ("key STRING, value STRING, expires_at TIMESTAMP, created_at TIMESTAMP"),
}

LOG = (
    "timestamp TIMESTAMP, level STRING, message STRING, logger STRING, run_id STRING, "
    "company STRING, stage STRING, duration_seconds DOUBLE, status STRING, errors STRING, "
    "retries INT, _corrupt_record STRING"
)

_DOUBLES = ("role_match", "tech_stack", "salary", "company_quality", "growth", "confidence")


def _required(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, nullable=False)


def _optional(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, nullable=True)


_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_LIST = T.ArrayType(T.StringType())


def _rows_of(*fields: T.StructField) -> T.ArrayType:
    return T.ArrayType(T.StructType(list(fields)))


# Every key must be present in a response; ``nullable`` says whether its value may be null.
RESPONSES: dict[str, T.StructType] = {
    "company_list": T.StructType([_required("companies", _rows_of(
        _required("name", _S), _optional("domain", _S), _optional("employee_count", _I),
        _optional("industry", _S)))]),
    "job_list": T.StructType([_required("jobs", _rows_of(
        _required("title", _S), _optional("url", _S), _optional("location", _S),
        _optional("salary", _S), _optional("experience_years", _D), _optional("description", _S)))]),
    "company_research": T.StructType([
        _required("business_model", _S), _required("funding", _S), _required("tech_stack", _LIST),
        _required("culture", _S), _required("leadership", _LIST)]),
    "contact_list": T.StructType([_required("contacts", _rows_of(
        _required("name", _S), _required("role", _S), _optional("email_pattern", _S),
        _optional("linkedin_url", _S)))]),
    "email_discovery": T.StructType([_optional("email", _S), _optional("pattern_used", _S)]),
    "opportunity_score": T.StructType(
        [_required(c, _D) for c in _DOUBLES] + [_required("reasoning", _S)]),
    "resume_tailor": T.StructType([
        _required("tailored_typst_content", _S), _required("keywords_added", _LIST),
        _required("reasoning", _S)]),
    "email_message": T.StructType([_required("subject", _S), _required("body_html", _S)]),
    "validation": T.StructType([_required("is_valid", _B), _required("errors", _LIST)]),
    "targeted_parse": T.StructType([
        _required("company_name", _S), _optional("domain", _S), _optional("contact_email", _S),
        _optional("contact_name", _S)]),
    "jd_parse": T.StructType([
        _required("title", _S), _optional("location", _S), _optional("salary", _S),
        _optional("experience_years", _D), _required("description", _S)]),
}
