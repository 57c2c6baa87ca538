"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the test tables, BENCH_CPUS the local cores. Every query is run to
the end without keeping its rows; each is run twice and the faster time counts, as the
first run also pays for class loading and code generation. Reports run on outcomes
that are persisted once, the way a user makes a set of reports; filling the cache is
timed on its own.
"""

from __future__ import annotations

import json
import os
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from gapscan.catalog import queries as catalog
from gapscan.plans.outcomes import gap_outcomes
from gapscan.plans.report_cube import Cube
from gapscan.plans.reports import REPORTS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "candles_dedup", "gaps_room_up", "ema_21", "sma_distances", "avwap_quarterly", "forward_bars", "retrace_ema21",
    "gap_outcomes_up", "gap_outcomes_down", "gap_outcomes_month", "summary_by_date", "top_gaps_per_date", "first_touch_250", "asof_close", "avwap_since",
    "nested_rules",
    "changes_only", "distinct_blocks", "grouped_first_seen", "style_rules", "strip_comments", "latest_snapshots",
]


def seconds(build) -> float:
    best = float("inf")
    for _ in range(RUNS):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("gapscan-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: seconds(lambda: catalog.QUERIES[name](spark, SF_DIR)) for name in HEADLINE}

    both = lambda: gap_outcomes(catalog.raw(spark, SF_DIR), "both")
    times["gap_outcomes_both"] = seconds(both)

    published: DataFrame = catalog.published(spark, SF_DIR).persist(StorageLevel.MEMORY_AND_DISK)
    start = time.perf_counter()
    published.count()
    times["persist_published"] = round(time.perf_counter() - start, 3)
    for name, report in REPORTS.items():
        times[name] = seconds(lambda: report(published))
    times["all_reports"] = round(sum(times[name] for name in REPORTS), 3)

    def all_of_cube() -> None:
        cube = Cube.of(published)
        kept = Cube(cube.sums.coalesce(1).persist(), cube.known)
        for table in kept.reports().values():
            table.write.format("noop").mode("overwrite").save()
        kept.sums.unpersist()

    for _ in range(RUNS):
        start = time.perf_counter()
        all_of_cube()
        times["grouped_reports_in_one_pass"] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "gap_outcomes_up wall time",
        "value": times["gap_outcomes_up"],
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
