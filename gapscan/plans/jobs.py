"""The two jobs end to end: bars to an outcome file, an outcome file to report tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscan.plans.outcomes import gap_outcomes
from gapscan.plans.reports import REPORTS
from gapscan.plans.summaries import summary_by_date
from gapscan.sources.bars import OPEN, trading_dates
from gapscan.sources.outcome_files import publish, read_outcomes, write_outcomes


def analyze(
    bars: DataFrame, folder: str, mode: str = "up", start: str | None = None, end: str | None = None, **settings
) -> DataFrame:
    """Writes the outcomes of the dates in [start, end] to folder/output-<direction>.

    Without dates, the last 30 days; OPEN leaves a side open. A file has one direction,
    so mode both is run as its two modes, one after the other. Returns the summary by date, read back from the
    written files rather than computed a second time.
    """
    if mode not in ("up", "down", "both"):
        raise ValueError(f"mode must be up, down or both, not {mode!r}")
    spark = bars.sparkSession
    today, month_ago = spark.range(1).select(F.current_date().cast("string"), F.date_sub(F.current_date(), 30).cast("string")).first()
    start, end = start or month_ago, end or today
    bounds = [None if bound == OPEN else bound for bound in (start, end)]
    read = None
    for one in ("up", "down") if mode == "both" else (mode,):
        path = f"{folder}/output-{'short' if one == 'up' else 'long'}"
        write_outcomes(gap_outcomes(bars, one, *bounds, **settings), path)
        outcomes = read_outcomes(spark, path)
        read = outcomes if read is None else read.unionByName(outcomes)
    return summary_by_date(read, trading_dates(bars, start, end))


def report(outcomes: DataFrame, folder: str, names: Iterable[str] | None = None) -> dict[str, str]:
    """Writes report tables as parquet, one folder each, over outcomes persisted once."""
    published = publish(outcomes).persist(StorageLevel.MEMORY_AND_DISK)
    paths = {}
    try:
        for name in names or REPORTS:
            paths[name] = f"{folder}/{name}"
            REPORTS[name](published).write.mode("overwrite").parquet(paths[name])
    finally:
        published.unpersist()
    return paths


def report_from_file(spark: SparkSession, path: str, folder: str) -> dict[str, str]:
    return report(read_outcomes(spark, path), folder)
