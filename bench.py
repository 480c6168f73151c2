"""Wall time of the headline queries: one JSON line.

Each query runs once to warm up and then three times into a sink that keeps nothing;
the median counts. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sillage.catalog import QUERIES  # noqa: E402
from sillage.session import build_session  # noqa: E402

HEADLINE = (
    "K01_kpi_nights", "K04_kpi_top_departments", "K06_kpi_period_nights", "K10_kpi_peak", "K17_kpi_saturday_2",
    "K25_kpi_mean_stay", "K31_block_a", "K32_block_d7",
    "R01_comparison_table", "R07_origins_departments", "R11_destinations", "R12_top_destinations", "R15_stay_distribution", "R16_stay_combined",
    "C09_compare_ab", "C11_trend_class", "C14_gainers_losers",
    "J08_in_period", "P01_resolve_period", "P12_link_seasons", "P16_period_conflicts",
    "A01_preagg", "A16_peak_day", "D01_get_or_create", "D10_load_history", "V02_reject_report", "V03_dedupe_grain",
    "S01_read_useful", "S14_rows_from_json", "S17_merge_overwrite", "S22_replace_dates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for key in wanted:
        runs = []
        for _ in range(4):
            begun = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begun)
        times[key] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "headline_query_seconds_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
