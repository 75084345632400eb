"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated subset.  Each query runs once to warm up and is then timed to a full
``noop`` write, so no column is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emberwatch.plans.registry import all_queries  # noqa: E402
from emberwatch.session import local_session  # noqa: E402

HEADLINE = [
    "block_features",
    "event_features",
    "realtime_block_features",
    "normalize_template",
    "template_catalog",
    "threat_flags_batch",
    "weighted_keyword_score",
    "mask_tokens",
    "rule_alerts",
    "cve_enrich_category",
    "alert_cooldown",
    "alert_view",
    "sequence_gaps",
    "missing_line_ids",
    "roc_auc",
    "impute_median",
    "score_distribution",
    "iforest_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores)
    registered, times = all_queries(), {}

    def run(name):
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    for name in names:
        run(name)
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
