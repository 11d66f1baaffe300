"""Time the headline queries and print one JSON line.

Every query is planned from scratch and written to the no-op sink, so all its rows are computed and
none is collected. A first pass warms the JVM; the second one counts.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hirelake.plans.registry import QUERIES  # noqa: E402
from hirelake.session import local_session  # noqa: E402

HEADLINE = (
    "application_advance", "history_emit", "targeted_advance", "active_applications",
    "application_list", "application_details", "status_summary_web", "export_record",
    "filter_cascade", "job_upsert", "company_upsert", "best_contact", "first_valid_email",
    "clean_applications", "cache_lookup", "domain_breaker", "response_parse", "page_text",
    "chunk_assembly", "integrity_audit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "hirelake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for keep in (False, True):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if keep:
                seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
