"""Time the headline queries; prints one JSON line.

Each query is set up and run in full, with every row produced, three times; the
median counts. ``full_run`` computes and writes every dataset
once, over facts aggregated once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import compare, fixtures, registry  # noqa: E402
from tradeweave.plans import pipeline  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "scan_trade_regime",
    "fig_1a",
    "percent_export_total",
    "all_degree_summary",
    "bilateral_habitat_method_summary",
    "export_concentration_n_countries",
    "trade_region_method",
    "bilateral_flow_change",
    "top_exporters_new",
    "regional_avg_annual_change",
    "ldc_net_habitat_method_summary",
    "trade_ts_union",
    "consumption_percap_adjusted",
    "top_scinames_source_consumer",
    "supply",
    "fig4b",
    "sankey_regions_marine_capture",
    "trade_totals",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = compare.session(CPUS)
    queries = registry.queries()

    def run(name: str) -> None:
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in HEADLINE:
        seconds[name] = round(statistics.median(timed(lambda: run(name)) for _ in range(RUNS)), 3)
    with tempfile.TemporaryDirectory(prefix="tradeweave-bench-") as out:
        seconds["full_run"] = round(timed(lambda: pipeline.run(fixtures.study(spark, SF_DIR), out)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
