"""Plan shapes: what must and must not appear when tables are too large to broadcast."""

import pytest

from hirelake.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Queries that run jobs before they return their plan.
NOT_LAZY = {"draft_quota", "structured_generate", "discovery_run", "application_advance", "history_emit", "stage_gate", "targeted_advance",
            "advance_contacts", "advance_emails", "advance_resumes", "export_incremental", "log_scan"}
PYTHON = {"page_text_parsed"}
LAZY = [n for n in QUERIES if n not in NOT_LAZY and not n.startswith("stream_")]


@pytest.fixture
def large(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins_no_python(large, name):
    text = plan(QUERIES[name](large, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text
    assert ("MapInPandas" in text) == (name in PYTHON)


@pytest.mark.parametrize("name", ["topn_hits", "domain_breaker", "email_conflict_relink"])
def test_rank_bound_runs_before_the_shuffle(large, name):
    text = plan(QUERIES[name](large, SF_DIR))
    assert text.count("WindowGroupLimit") == 2  # partial and final


@pytest.mark.parametrize("name", [n for n in LAZY if n not in (
    "topn_hits", "hits_union", "chunk_assembly", "domain_breaker", "email_conflict_relink", "search_results",
    "company_upsert", "job_upsert", "contact_upsert")])
def test_no_windows_over_unbounded_groups(large, name):
    assert "Window [" not in plan(QUERIES[name](large, SF_DIR))


@pytest.mark.parametrize("name", ["company_list", "contact_list", "job_list", "recent_applications", "log_tail"])
def test_lists_are_top_k(large, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](large, SF_DIR))


def test_audit_reads_every_table_once(large):
    text = plan(QUERIES["integrity_audit"](large, SF_DIR))
    assert text.count("FileScan") == 9 and "Join" not in text


def test_second_engine_is_read_for_unanswered_queries(large):
    text = plan(QUERIES["search_results"](large, SF_DIR))
    assert "LeftAnti" in text and text.count("WindowGroupLimit") >= 4


def test_summary_is_one_aggregate(large):
    text = plan(QUERIES["status_summary_cli"](large, SF_DIR))
    assert text.count("FileScan") == 1


def test_pruned_and_pushed(spark):
    text = plan(QUERIES["filter_company_exclusion"](spark, SF_DIR))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in text
    text = plan(QUERIES["job_upsert"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(o_orderdate)" in text
