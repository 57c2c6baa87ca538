"""Summaries by date that merge: counts, extremes, distinct tickers and quantiles of any range of dates without its outcomes.

A date's row holds a few kilobytes whatever it has seen: a HyperLogLog sketch of its tickers and a KLL sketch of each measured column. Sketches of
dates merge into those of ranges, so a report over years reads one small row per date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscan.plans.reports import HORIZONS

#: Size parameters: a standard error of about 1.6 % of a distinct count, and of about 0.7 % of the rows for a quantile's rank.
HLL_BITS, KLL_SIZE = 12, 400
MEASURED = ("gap_up_percent", *[f"{c}_{h}d" for h in HORIZONS for c in ("mfe_percent", "mae_percent")])
QUANTILES = {"lower_quartile": 0.25, "median": 0.5, "upper_quartile": 0.75}


def daily_sketches(outcomes: DataFrame, measured: Sequence[str] = MEASURED, by: Sequence[str] = ("date",)) -> DataFrame:
    """One row per date: rows, tickers (a sketch), and of each measured column n, least, most and a sketch of its known values.

    A missing date is a row of its own. A column without a known value on a date has n = 0 and a null sketch. Sketches are combined before the
    shuffle, so a date with most outcomes is no single task's work.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("ticker", F.lit(HLL_BITS)).alias("tickers"), F.max("direction").alias("direction")]
    for c in measured:
        value = F.col(c).cast("double")
        sums += [
            F.count(value).alias(f"{c}_n"), F.min(value).alias(f"{c}_least"), F.max(value).alias(f"{c}_most"),
            F.kll_sketch_agg_double(value, F.lit(KLL_SIZE)).alias(f"{c}_sketch"),
        ]
    table = outcomes.groupBy(*by).agg(*sums)
    return table.withColumns({f"{c}_sketch": F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sketch")) for c in measured})


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of dates as one row, or one per group: still sketches, which merge further."""
    measured = [c.removesuffix("_sketch") for c in sketches.columns if c.endswith("_sketch")]
    sums = [F.sum("n").alias("n"), F.hll_union_agg("tickers", F.lit(True)).alias("tickers"), F.max("direction").alias("direction")]
    for c in measured:
        sums += [
            F.sum(f"{c}_n").alias(f"{c}_n"), F.min(f"{c}_least").alias(f"{c}_least"), F.max(f"{c}_most").alias(f"{c}_most"),
            F.kll_merge_agg_double(f"{c}_sketch", F.lit(KLL_SIZE)).alias(f"{c}_sketch"),
        ]
    table = sketches.groupBy(*by).agg(*sums)
    return table.withColumns({f"{c}_sketch": F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sketch")) for c in measured})


def in_range(sketches: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The dates of [start, end]; None leaves a side open. A filter that reaches the stored table."""
    inside = F.lit(True)
    if start is not None:
        inside &= F.col("date") >= F.to_date(F.lit(start))
    if end is not None:
        inside &= F.col("date") <= F.to_date(F.lit(end))
    return sketches.where(inside)


def header(sketches: DataFrame) -> DataFrame:
    """As `reports.header`, with dates exact and an estimate of the distinct tickers."""
    dates = F.count_distinct("date").alias("date_count")
    return sketches.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), dates, F.coalesce(F.max("direction"), F.lit("unknown")).alias("direction"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("tickers", F.lit(True))), F.lit(0)).alias("ticker_count"),
    )


def box(sketches: DataFrame, column: str = "gap_up_percent", by: Sequence[str] = ()) -> DataFrame:
    """Five-number summary of a column: extremes exact, quartiles by rank within the sketch's error; null without a known value."""
    whole = merged(sketches, by)
    quartiles = [F.when(F.col(f"{column}_n") > 0, F.kll_sketch_get_quantile_double(f"{column}_sketch", F.lit(q))).alias(name) for name, q in QUANTILES.items()]
    return whole.select(*by, F.col(f"{column}_least").alias("lowest"), *quartiles, F.col(f"{column}_most").alias("highest"))


def share_up_to(sketches: DataFrame, column: str, value: float) -> DataFrame:
    """Which share of a column's known values is at most `value`, by the sketch's estimate."""
    whole = merged(sketches)
    rank = F.kll_sketch_get_rank_double(f"{column}_sketch", F.lit(float(value)))
    return whole.select(F.when(F.col(f"{column}_n") > 0, rank).alias("share"))
