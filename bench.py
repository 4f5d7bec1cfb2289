"""Headline queries on one data folder; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stipendia.plans.workload import REGISTRY  # noqa: E402
from stipendia.session import local_session  # noqa: E402

HEADLINE = [
    "national_tiles", "college_performance", "scheme_comparison", "stage_durations", "cohort_funnel", "disbursement_overview",
    "college_workload", "age_buckets", "application_export", "admin_table", "status_steps", "document_versions", "scheme_matches",
    "best_schemes", "selection_preview", "rule_impact", "intake_verdicts", "case_status", "consistency_score", "readiness",
    "text_types", "text_titles", "marksheet10_fields", "income_fields", "masked_texts", "duplicate_groups", "question_slots",
    "question_intents", "best_answers", "field_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, int(cores) if cores.isdigit() else 8, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
