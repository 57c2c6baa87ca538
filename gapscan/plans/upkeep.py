"""Outcomes kept up to date as bars arrive: only the dates that new bars can change are worked out again.

The table has a folder for each direction and date. A new bar changes the outcomes of its symbol's bars before it, as far as
they look ahead, its own, and, if it comes late, those of the bars after it, as far as they look back; a bar of
the benchmark changes its date and its next one for all symbols. Those dates' folders are replaced, others are neither read nor written.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscan.functions.columns import BY_SYMBOL, add
from gapscan.operators import indicators
from gapscan.operators.indicators import SMA_330, STANDARD_SMAS
from gapscan.plans.outcomes import gap_outcomes
from gapscan.schema import HORIZONS, OUTCOME_COLUMNS, QUARTER_ANCHORS
from gapscan.sources.bars import bars as typed_bars
from gapscan.sources.folders import Folders

#: How far outcomes look ahead, in bars, and back, in bars and in days (to the anchor a year before the quarter).
AHEAD = max(HORIZONS)
BACK_BARS = max(SMA_330.bars, *(a.bars for a in STANDARD_SMAS), indicators.EMA_BARS)
BACK_DAYS = max(QUARTER_ANCHORS.values()) + 92
#: Dates that are at most so many days apart are worked out together.
TOGETHER = 31


def changed_dates(bars: DataFrame, arrived: DataFrame, benchmark: str = "SPY") -> DataFrame:
    """The dates whose outcomes can differ once the bars of `arrived` (symbol, date) are among `bars`, ascending.

    Only symbols and dates of the bars are read. Missing dates and symbols belong to no date's outcomes. Each bar looks up the last new bar up to
    itself, and up to the last bar it looks ahead to, in running maxima: what a bar costs does not depend on how far it looks.
    """
    known = bars.selectExpr("symbol", "date", "1 as _known", "null as _new")
    new = arrived.selectExpr("symbol", "cast(date as date) as date", "null as _known", "1 as _new")
    both = known.unionByName(new).where("symbol is not null and date is not null").groupBy("symbol", "date")
    marked = both.agg(F.max("_known").alias("_known"), F.max("_new").alias("_new")).where("_known is not null").drop("_known")
    so_far = f"over ({BY_SYMBOL} rows between unbounded preceding and current row)"
    numbered = add(marked, {"_bar": f"row_number() over ({BY_SYMBOL})"})
    last = add(numbered, {"_last_bar": f"max(if(_new = 1, _bar, 0)) {so_far}", "_last_date": f"max(if(_new = 1, date, null)) {so_far}"})
    near = add(last, {
        "_last_ahead": f"coalesce(lead(_last_bar, {AHEAD}) over ({BY_SYMBOL}), max(_last_bar) over (partition by symbol))",
        "_before": f"lag(_new) over ({BY_SYMBOL})",
    })
    changed = f"_last_ahead >= _bar or _bar - nullif(_last_bar, 0) <= {BACK_BARS} or datediff(date, _last_date) <= {BACK_DAYS}"
    # the benchmark's own gaps change like any symbol's, and with its gains those of every symbol
    gains = (F.col("symbol") == benchmark) & F.expr("coalesce(_new, _before) is not null")
    return near.where(F.expr(changed) | gains).select("date").distinct().orderBy("date")


def runs_of(dates: list[dt.date]) -> list[list[dt.date]]:
    """Ascending dates in runs without a wide hole."""
    runs: list[list[dt.date]] = []
    for date in dates:
        if runs and (date - runs[-1][-1]).days <= TOGETHER:
            runs[-1].append(date)
        else:
            runs.append([date])
    return runs


def outcomes_of(bars: DataFrame, dates: list[dt.date], mode: str, **settings) -> DataFrame | None:
    """Outcomes of the given dates, a run of near dates at a time; bars that none of them looks at are left out."""
    out = None
    for run in runs_of(dates):
        part = gap_outcomes(bars, mode, str(run[0]), str(run[-1]), **settings).where(F.col("date").isin(*run))
        out = part if out is None else out.unionByName(part)
    return out


def update_outcomes(bars: DataFrame, arrived: DataFrame, path: str, mode: str = "up", benchmark: str = "SPY", **settings) -> list[dt.date]:
    """Brings the outcome table at `path` up to date with bars of which `arrived` (symbol, date) are new or different.

    `bars` are all bars, the new ones included. Returns the dates that were worked out again: their folders are replaced, those without outcomes
    now go. The first call, on a path without a table, works out all dates of `arrived`. Running an update again gives the
    same table, so one that failed is simply repeated.
    """
    if mode not in ("up", "down", "both"):
        raise ValueError(f"mode must be up, down or both, not {mode!r}")
    spark = bars.sparkSession
    bars = typed_bars(bars)
    # at most a row per calendar day
    dates = [r[0] for r in changed_dates(bars, arrived, benchmark).collect()]
    if not dates:
        return []
    staging = f"{path}.staging"
    outcomes_of(bars, dates, mode, benchmark=benchmark, **settings).write.mode("overwrite").parquet(staging)
    outcomes = read_table(spark, staging)
    keys = outcomes.select("direction", "date").distinct().collect()
    by_date = outcomes.repartition("direction", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    by_date.partitionBy("direction", "date").parquet(path)
    for direction in {"up": ["short"], "down": ["long"], "both": ["short", "long"]}[mode]:
        folder = Folders(spark, f"{path}/direction={direction}")
        names = {f"date={date}" for date in dates} & set(folder.names())
        for name in names - {f"date={date}" for d, date in keys if d == direction}:
            folder.delete(name)
    Folders(spark, staging).delete()
    return dates


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The outcome table, with its columns in their usual order."""
    schema = ", ".join(f"{name} {kind}" for name, kind in OUTCOME_COLUMNS.items()) + ", direction string"
    return spark.read.schema(schema).parquet(path).select(*OUTCOME_COLUMNS, "direction")
