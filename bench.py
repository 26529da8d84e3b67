"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1). BENCH_CPUS: local threads.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from carequeue.plans.registry import QUERIES

HEADLINE = [
    "priority_score",
    "readmit_risk",
    "specialty_analysis",
    "cost_impact",
    "seasonal_analysis",
    "age_based_risk",
    "overview_kpis",
    "high_risk_patients_list",
    "queue_position",
    "optimize_schedule",
    "fixed_sample",
    "capacity_impact",
    "weekly_backlog",
    "staffing_options",
    "cancellation_whatif",
    "classify_questions",
    "extract_parameters",
    "answer_questions",
    "format_answers",
    "term_lookup",
    "suggest_queries",
    "efficiency_model",
    "answers_by_request",
    "suggest_asked",
    "term_lookup_documents",
    "queue_after_batches",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("carequeue-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("specialty_analysis")  # start-up of the session
    times = {name: run(name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
