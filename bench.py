"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) set the
data and the cores.  Each query is run once to warm up and then ``BENCH_RUNS``
(default 3) times; the median is kept.  Rows go to Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from daybook.checks import all_queries  # noqa: E402
from daybook.session import build  # noqa: E402

HEADLINE = (
    "daily_digest",
    "commit_scan",
    "digest_totals",
    "type_summary",
    "classify",
    "noise_filter_fallback",
    "commit_cap",
    "lookback_strict_walk",
    "redact_text",
    "redaction_counts",
    "clean_text",
    "cache_lookup",
    "retention_deleted",
    "stale_keys",
    "usage_report",
    "admission",
    "log_redact",
    "log_view",
    "score_payload",
    "attempt_select",
    "section_extract",
    "rendered_output",
    "template_lookup",
    "settings_resolve",
    "settings_validate",
)


def run_once(build_query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    build_query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    seconds = {}
    for name in names:
        run_once(queries[name], spark, sf_dir)
        seconds[name] = round(
            statistics.median(run_once(queries[name], spark, sf_dir) for _ in range(runs)), 4
        )
        print(f"{name:24} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
