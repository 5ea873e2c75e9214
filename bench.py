"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names instead of the headline set, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.registry import entries, runner  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "j01_most_reacted_messages",
    "j03_most_reacted_platforms",
    "j07_active_channels",
    "j13_game_response",
    "j18_spike_response",
    "j20_daily_trend",
    "j21_country_response",
    "j29_statistics_text",
    "j36_keyword_frequency",
    "i02_regional_rates",
    "i08_best_sellers",
    "i13_daily_summary",
    "i14_month_to_date",
    "i15_cohort_retention",
    "i16_user_types",
    "d20_metric_view",
    "w04_latest_record",
    "w11_decide_trials",
    "c20_sequence_next",
    "k02_compare_results",
    "k02_compare_other_columns",
    "k04_parse_verdicts",
    "k07_categorize_text",
    "k09_categorize_failures",
    "k13_extract_responses",
    "k15_assign_chunks",
    "l03_metadata_adds_columns",
    "l11_apply_plan_outcomes",
    "l12_validate_models",
    "l15_diff_models",
    "m01_summarize_iteration",
    "m08_failure_patterns",
    "n01_fingerprint_queries",
    "n04_mine_synonyms",
]


def seconds(run) -> float:
    """Time of one full run: every output row is computed, none is collected."""
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    known = entries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(known) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(cpus, app="bench")
    seconds(lambda: runner(known[HEADLINE[0]])(spark, folder))  # starts the JVM's code paths
    times = {}
    for name in names:
        times[name] = round(seconds(lambda: runner(known[name])(spark, folder)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
