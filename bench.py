"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs end to end and is fully executed with a no-op write.  Nothing is
kept between queries: each derives its document tables from the input again.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "flagship",
    "issues_by_code",
    "balanced_reversal",
    "issue_order",
    "line_item_prf",
    "issue_code_prf",
    "eval_breakdown",
    "strict_json",
    "revalidate",
    "route_formats",
    "page_assembly",
    "cell_limits",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from docaudit.plans.queries import all_queries
    from docaudit.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = all_queries()
    # warm the JVM once (not timed)
    qs["issues_by_code"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
