"""Counts and rates of retracement, by date and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscan.functions.measures import flag


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def summary_by_date(outcomes: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per date, zeros where it had no gaps, by date."""
    counts = outcomes.groupBy("date").agg(
        F.count(F.lit(1)).alias("total_gap_ups"),
        F.sum(flag("retraced_to_vwap_5d")).alias("retraced_to_vwap_5d"),
        F.sum(flag("retraced_to_vwap_10d")).alias("retraced_to_vwap"),
    )
    filled = dates.select("date").distinct().join(counts, "date", "left").fillna(0)
    total = F.col("total_gap_ups")
    return filled.select(
        "date",
        "total_gap_ups",
        "retraced_to_vwap_5d",
        _share(F.col("retraced_to_vwap_5d"), total).alias("retracement_rate_5d"),
        "retraced_to_vwap",
        _share(F.col("retraced_to_vwap"), total).alias("retracement_rate"),
    ).orderBy("date")


def summary_overall(by_date: DataFrame) -> DataFrame:
    """Totals and rates over a summary by date."""
    sums = by_date.agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_gap_ups", "retraced_to_vwap_5d", "retraced_to_vwap")
    ])
    total = F.col("total_gap_ups")
    return sums.select(
        "total_gap_ups",
        "retraced_to_vwap_5d",
        _share(F.col("retraced_to_vwap_5d"), total).alias("overall_rate_5d"),
        "retraced_to_vwap",
        _share(F.col("retraced_to_vwap"), total).alias("overall_rate_10d"),
    )
