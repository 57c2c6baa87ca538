"""Report tables over published outcomes.

Each function takes the outcome table of one report and returns one table. Reports
aggregate before they shuffle, to at most one row per year, month, date or bucket;
what follows works on those few rows. Persist the outcomes to make many reports.

Horizons are days, 5 or 10. Rates are percentages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscan.functions import buckets
from gapscan.functions.buckets import Buckets
from gapscan.functions.measures import (
    clipped,
    exact_mean,
    exact_sum,
    flag,
    fraction_profit_factor,
    if_known,
    known,
    rate,
    retrace_fraction,
    win_profit_factor,
)
from gapscan.schema import HORIZONS, QUARTER_ANCHORS, SMA_PERIODS

TRADE_SIZE = 10_000.0
LARGEST_LOSS, LARGEST_WIN = -600.0, 1200.0


def header(outcomes: DataFrame) -> DataFrame:
    """Rows, distinct dates and direction."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("date").alias("date_count"),
        F.coalesce(F.max("direction"), F.lit("unknown")).alias("direction"),
    )


def overall_rates(outcomes: DataFrame) -> DataFrame:
    """Rates of AVWAP retracement, 21-EMA retracement and gap fill, per horizon."""
    conditions = {"avwap": "retraced_to_vwap", "ema21": "retraced_to_21ema", "gap_fill": "gap_filled"}
    return outcomes.agg(*[
        F.round(if_known(outcomes, f"{condition}_{h}d", rate(f"{condition}_{h}d")), 2).alias(f"{name}_rate_{h}d")
        for name, condition in conditions.items()
        for h in HORIZONS
    ])


def profit_factor_overall(outcomes: DataFrame) -> DataFrame:
    """Profit factor of the retrace fractions per horizon; 0 when there is no loss nor profit."""
    return outcomes.agg(*[
        if_known(
            outcomes,
            f"retrace_percentage_{h}d",
            F.coalesce(F.round(fraction_profit_factor(f"retrace_percentage_{h}d"), 2), F.lit(0.0)),
        ).alias(f"profit_factor_{h}d")
        for h in HORIZONS
    ])


def _performance(outcomes: DataFrame, h: int) -> list[Column]:
    measures = {
        "avwap_rate": (rate, f"retraced_to_vwap_{h}d"),
        "avwap_pf": (fraction_profit_factor, f"retrace_percentage_{h}d"),
        "gap_close_rate": (rate, f"gap_filled_{h}d"),
        "gap_close_pf": (win_profit_factor, f"gap_filled_{h}d"),
        "ema21_rate": (rate, f"retraced_to_21ema_{h}d"),
        "ema21_pf": (win_profit_factor, f"retraced_to_21ema_{h}d"),
    }
    return [
        F.count(F.lit(1)).alias("trades"),
        *[two_decimals(if_known(outcomes, of, measure(of))).alias(name) for name, (measure, of) in measures.items()],
    ]


def two_decimals(measure: Column) -> Column:
    infinite = F.lit(float("inf"))
    return F.when(measure == infinite, infinite).otherwise(F.round(measure, 2))


def performance_by_year(outcomes: DataFrame, h: int) -> DataFrame:
    dated = outcomes.where(F.col("date").isNotNull())
    return dated.groupBy(F.year("date").alias("year")).agg(*_performance(outcomes, h)).orderBy("year")


def performance_by_gap_size(outcomes: DataFrame, h: int) -> DataFrame:
    """Performance per gap size bucket; empty buckets have 0 trades and null measures."""
    grouped = _by_bucket(outcomes, buckets.GAP_SIZE, F.col("gap_up_percent")).agg(*_performance(outcomes, h))
    return _ordered(buckets.GAP_SIZE.complete(grouped, counts=["trades"]))


def _by_bucket(outcomes: DataFrame, which: Buckets, value: Column):
    """Outcomes with a bucket, grouped by its number."""
    return outcomes.withColumn("bucket_no", which.ordinal(value)).where("bucket_no is not null").groupBy("bucket_no")


def _ordered(table: DataFrame) -> DataFrame:
    return table.orderBy("bucket_no")


def _month(date: str = "date") -> Column:
    return F.trunc(date, "month")


def trailing_mean(value: str, rows: int) -> Column:
    # Rows here are months: a century has 1200, so one unpartitioned window is small.
    return F.avg(value).over(Window.orderBy("month").rowsBetween(1 - rows, 0))


def monthly_sma5(outcomes: DataFrame) -> DataFrame:
    """Retracement per month, with means over the last five months there are."""
    monthly = (
        outcomes.where(F.col("date").isNotNull())
        .groupBy(_month().alias("month"))
        .agg(
            F.count("ticker").alias("total"),
            *[
                if_known(outcomes, f"retraced_to_vwap_{h}d", F.sum(flag(f"retraced_to_vwap_{h}d"))).cast("bigint").alias(f"retraced{h}")
                for h in HORIZONS
            ],
        )
    )
    share = lambda h: F.when(F.col("total") > 0, F.col(f"retraced{h}") * 100 / F.col("total"))
    rated = monthly.withColumns({f"rate{h}": share(h) for h in HORIZONS})
    return rated.withColumns({f"sma{h}": trailing_mean(f"rate{h}", 5) for h in HORIZONS}).orderBy("month")


def _monthly_rates(outcomes: DataFrame) -> DataFrame:
    dated = outcomes.where(F.col("date").isNotNull()).groupBy(_month().alias("month"))
    return dated.agg(*[rate(f"retraced_to_vwap_{h}d").alias(f"rate{h}") for h in HORIZONS])


def monthly_win(outcomes: DataFrame, h: int) -> DataFrame:
    """Win rate per month with its mean over the last 14 months there are; no rows for a horizon that is not known."""
    rates = _monthly_rates(outcomes).where(F.lit(known(outcomes, f"retraced_to_vwap_{h}d"))).select("month", F.col(f"rate{h}").alias("rate"))
    return rates.withColumn("ma14", trailing_mean("rate", 14)).orderBy("month")


def monthly_win_both(outcomes: DataFrame) -> DataFrame:
    """Win rate per month and known horizon, one row each."""
    have = F.array(*[F.lit(f"{h}d") for h in HORIZONS if known(outcomes, f"retraced_to_vwap_{h}d")]).cast("array<string>")
    long = _monthly_rates(outcomes).selectExpr("month", "stack(2, '5d', rate5, '10d', rate10) as (horizon, rate)")
    return long.where(F.array_contains(have, F.col("horizon"))).orderBy("month", "horizon")


def gap_histogram(outcomes: DataFrame, bins: int = 40) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest gap, the last one closed."""
    gap = F.col("gap_up_percent")
    return histogram_of(outcomes.where(gap.isNotNull()).groupBy(gap.alias("gap")).agg(F.count(F.lit(1)).alias("n")), bins)


def histogram_of(counted: DataFrame, bins: int = 40) -> DataFrame:
    """The histogram of gaps that occur n times each."""
    # the bounds read the counts too, so that they share the shuffle of what is counted
    there = F.when(F.col("n") > 0, F.col("gap"))
    lowest, highest = (counted.agg(bound(there)).scalar() for bound in (F.min, F.max))
    number = F.when(
        F.col("highest") > F.col("lowest"), F.least(F.expr(f"width_bucket(gap, lowest, highest, {bins})"), F.lit(bins))
    ).otherwise(F.lit(1))
    placed = counted.select("gap", "n", lowest.alias("lowest"), highest.alias("highest"))
    filled = placed.groupBy(number.alias("bin")).agg(F.sum("n").alias("count"))
    # At most one row per bin on both sides.
    edges = counted.sparkSession.range(1, bins + 1, 1, 1).select(
        F.col("id").alias("bin"), lowest.alias("lowest"), ((highest - lowest) / bins).alias("width")
    )
    return edges.join(F.broadcast(filled), "bin", "left").select(
        F.col("bin").cast("int").alias("bin"),
        (F.col("lowest") + (F.col("bin") - 1) * F.col("width")).alias("bin_low"),
        (F.col("lowest") + F.col("bin") * F.col("width")).alias("bin_high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    ).orderBy("bin")


def gap_box(outcomes: DataFrame) -> DataFrame:
    """Five-number summary of the gap size in two decimals, from counts of the distinct values.

    Rounding bounds their number, whatever the table: gaps of up to 1,000 percent have 100,000.
    """
    gap = F.round("gap_up_percent", 2)
    return box_of(outcomes.where(gap.isNotNull()).groupBy(gap.alias("gap")).agg(F.count(F.lit(1)).alias("n")))


def box_of(counted: DataFrame) -> DataFrame:
    """The five-number summary of gaps that occur n times each."""
    five = counted.agg(F.expr("percentile(gap, array(0.0, 0.25, 0.5, 0.75, 1.0), n)").alias("q"))
    names = ("lowest", "lower_quartile", "median", "upper_quartile", "highest")
    return five.select(*[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(names)])


def retrace_by_gap_bucket(outcomes: DataFrame) -> DataFrame:
    """10-day retracement rate and count per wide gap bucket; unknown results do not count."""
    grouped = _by_bucket(outcomes, buckets.GAP_WIDE, F.col("gap_up_percent")).agg(
        F.count("ticker").alias("total"),
        (F.avg(F.col("retraced_to_vwap_10d").cast("int")) * 100).alias("rate10"),
    )
    return _ordered(buckets.GAP_WIDE.complete(grouped, counts=["total"]))


def _win_by(outcomes: DataFrame, which: Buckets, value: Column, h: int) -> DataFrame:
    grouped = _by_bucket(outcomes, which, value).agg(
        if_known(outcomes, f"retraced_to_vwap_{h}d", rate(f"retraced_to_vwap_{h}d")).alias("rate")
    )
    return _ordered(which.complete(grouped))


def win_by_gap(outcomes: DataFrame, h: int) -> DataFrame:
    return _win_by(outcomes, buckets.GAP_WIDE, F.col("gap_up_percent"), h)


def win_by_avwap_distance(outcomes: DataFrame, h: int) -> DataFrame:
    """Win rate by the room from open to anchored VWAP in percent of the open, floored at 0."""
    return _win_by(outcomes, buckets.AVWAP_DISTANCE, room_percent(), h)


def room_percent() -> Column:
    room = F.col("open_price") - F.col("anchored_vwap")
    signed = F.when(F.lower("direction") == "short", room).otherwise(-room)
    percent = signed * 100 / F.nullif("open_price", F.lit(0.0))
    return F.when(percent.isNotNull(), F.greatest(percent, F.lit(0.0)))


def win_by_sma330(outcomes: DataFrame, h: int) -> DataFrame:
    return _win_by(outcomes, buckets.SMA_DISTANCE, F.col("sma_330_distance_percent"), h)


def win_by_benchmark(outcomes: DataFrame, h: int) -> DataFrame:
    """Win rate by the benchmark's change that day; changes outside [-5, 5) are left out."""
    return _win_by(outcomes, buckets.BENCHMARK_CHANGE, F.col("spy_daily_gain_percent"), h)


def _above_below(outcomes: DataFrame, levels: dict[str, str]) -> DataFrame:
    """Win rate above and below each level, per horizon; one pass, however many levels."""
    sides = [(level, side, column, f"{column} {test}")
             for level, column in levels.items()
             for side, test in (("Above", ">= 0"), ("Below", "< 0"))]
    counts = outcomes.agg(*[
        F.expr(sql).alias(f"{what}_{i}")
        for i, (_, _, _, where) in enumerate(sides)
        for what, sql in (
            ("n", f"count_if({where})"),
            ("w5", f"count_if({where} and retraced_to_vwap_5d)"),
            ("w10", f"count_if({where} and retraced_to_vwap_10d)"),
        )
    ])
    rows = [
        f"'{level}', '{side}', '{h}d', n_{i}, w{h}_{i}"
        for i, (level, side, _, _) in enumerate(sides)
        for h in HORIZONS
        if known(outcomes, f"retraced_to_vwap_{h}d")
    ]
    if not rows:
        return outcomes.limit(0).selectExpr("'' as level", "'' as side", "'' as horizon", "0D as rate")
    long = counts.selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as (level, side, horizon, n, wins)")
    return long.where("n > 0").selectExpr("level", "side", "horizon", "wins / n * 100 as rate")


ABOVE_BELOW_LEVELS = {f"{n}-SMA": f"sma_{n}_distance_percent" for n in SMA_PERIODS} | {
    f"{label} AVWAP": f"avwap_{name}_distance_percent"
    for label, name in zip(("Current Quarter", "2Q Ago", "3Q Ago", "1Y Ago"), QUARTER_ANCHORS)
}


def win_above_below(outcomes: DataFrame) -> DataFrame:
    """Win rate above and below the moving averages and quarter-anchored VWAPs."""
    return _above_below(outcomes, ABOVE_BELOW_LEVELS)


def win_above_below_330(outcomes: DataFrame) -> DataFrame:
    return _above_below(outcomes, {"330-SMA": "sma_330_distance_percent"})


def pnl(h: int) -> Column:
    """Expected profit of one trade: what a full retrace earns, weighted by how far it got."""
    price = F.col("open_price")
    shares = F.when(price > 0, F.lit(TRADE_SIZE) / price).otherwise(F.lit(0.0))
    distance = F.abs(F.col("anchored_vwap") - price)
    swing = retrace_fraction(f"retrace_percentage_{h}d") * 2 - 1
    return clipped(shares * distance * swing, LARGEST_LOSS, LARGEST_WIN)


def trade_pnl(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("ticker", "date", *[pnl(h).alias(f"pnl_{h}") for h in HORIZONS])


# Money is summed as decimals, which gives the same total in any order of adding.
_MONEY = "decimal(18,6)"


def pnl_totals(outcomes: DataFrame) -> DataFrame:
    """Total expected profit per horizon, null when no trade has one."""
    return trade_pnl(outcomes).agg(*[
        F.sum(F.col(f"pnl_{h}").cast(_MONEY)).cast("double").alias(f"total_pnl_{h}d") for h in HORIZONS
    ])


def equity_curve(outcomes: DataFrame) -> DataFrame:
    """Running profit over trades by date, per horizon; a horizon without any profit is left out.

    Within a date trades run by ticker. Tickers are cut into chunks by their first letters, which
    keeps their order. A running sum is what its date started with, plus what its chunk started with,
    plus the running sum in the chunk. So a date with very many trades is split into
    many tasks' worth, and only sums per date meet in one place.
    """
    zero = F.lit(0).cast(_MONEY)
    trades = trade_pnl(outcomes).withColumns({
        **{f"pnl_{h}": F.col(f"pnl_{h}").cast(_MONEY) for h in HORIZONS},
        # Trades without a date come last.
        "day": F.coalesce(F.unix_date("date"), F.lit(2**31 - 1)),
        "chunk": F.substring(F.coalesce("ticker", F.lit("")), 1, 3),
    }).repartition("day", "chunk")
    each = lambda make: [column for h in HORIZONS for column in make(h)]
    # Both horizons go through as columns, and become rows last.
    chunks = trades.groupBy("day", "chunk").agg(*each(lambda h: [
        F.coalesce(F.sum(f"pnl_{h}"), zero).alias(f"sum_{h}"), F.count(f"pnl_{h}").alias(f"known_{h}")
    ]))
    in_day = Window.partitionBy("day").orderBy("chunk")
    chunks = chunks.withColumns({f"end_{h}": F.sum(f"sum_{h}").over(in_day) for h in HORIZONS})
    days = chunks.groupBy("day").agg(*each(lambda h: [F.sum(f"sum_{h}").alias(f"day_{h}"), F.sum(f"known_{h}").alias(f"known_{h}")]))
    # At most one row per calendar day.
    by_day, over_all = Window.orderBy("day"), Window.partitionBy()
    days = days.select("day", *each(lambda h: [
        (F.sum(f"day_{h}").over(by_day) - F.col(f"day_{h}")).alias(f"before_{h}"), F.sum(f"known_{h}").over(over_all).alias(f"known_{h}")
    ]))
    starts = chunks.drop(*[f"known_{h}" for h in HORIZONS]).join(days, "day").select("day", "chunk", *each(lambda h: [
        (F.col(f"before_{h}") + F.col(f"end_{h}") - F.col(f"sum_{h}")).alias(f"start_{h}"), f"known_{h}"
    ]))
    in_chunk = Window.partitionBy("day", "chunk").orderBy("ticker").rowsBetween(Window.unboundedPreceding, 0)
    running = trades.withColumns({f"run_{h}": F.sum(F.coalesce(f"pnl_{h}", zero)).over(in_chunk) for h in HORIZONS})
    curves = F.array(*[
        F.when(F.col(f"known_{h}") > 0, F.struct(F.lit(f"{h}d").alias("horizon"), (F.col(f"start_{h}") + F.col(f"run_{h}")).cast("double").alias("equity")))
        for h in HORIZONS
    ])
    placed = running.join(starts, ["day", "chunk"]).select("date", "ticker", F.explode(F.filter(curves, lambda c: c.isNotNull())).alias("c"))
    return placed.select("c.horizon", "date", "ticker", "c.equity")


def gap_retrace_points(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("ticker", "date", "gap_up_percent", "retrace_percentage_10d", "retraced_to_vwap_10d")


def days_to_retrace(outcomes: DataFrame, h: int) -> DataFrame:
    """How many winners took each number of bars, and their share in percent."""
    won = outcomes.where(F.col(f"retraced_to_vwap_{h}d") & F.col(f"days_to_retrace_{h}d").isNotNull())
    counts = won.groupBy(F.col(f"days_to_retrace_{h}d").alias("day")).agg(F.count(F.lit(1)).alias("count"))
    # At most h rows are left here.
    everything = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("percentage", F.col("count") / everything * 100).orderBy("day")


def benchmark_vs_retrace(outcomes: DataFrame) -> DataFrame:
    """Per date, the benchmark's mean gain and the 10-day retracement rate."""
    per_date = outcomes.where(F.col("date").isNotNull()).groupBy("date")
    return per_date.agg(
        exact_mean(F.col("spy_daily_gain_percent")).alias("spy"),
        (F.avg(F.col("retraced_to_vwap_10d").cast("int")) * 100).alias("rate10"),
    ).orderBy("date")


def benchmark_trend(outcomes: DataFrame) -> DataFrame:
    """Least-squares line of the retracement rate over the benchmark's gain, by date."""
    return trend_of(benchmark_vs_retrace(outcomes))


def trend_of(points: DataFrame) -> DataFrame:
    return points.agg(
        F.round(F.regr_slope("rate10", "spy"), 6).alias("slope"),
        F.round(F.regr_intercept("rate10", "spy"), 6).alias("intercept"),
        F.round(F.regr_r2("rate10", "spy"), 6).alias("r2"),
    )


def top_mfe(outcomes: DataFrame, n: int = 20) -> DataFrame:
    """The n outcomes with the largest 10-day favourable excursion."""
    return (
        outcomes.orderBy(F.desc_nulls_last("mfe_percent_10d"), "ticker", "date")
        .limit(n)
        .select("ticker", "date", "gap_up_percent", "mfe_percent_10d", "mae_percent_10d", "retrace_percentage_10d")
    )


def _per_horizon(name: str, report) -> dict:
    return {f"{name}_{h}d": (lambda outcomes, h=h: report(outcomes, h)) for h in HORIZONS}


# Every report table by name.
REPORTS = {
    "report_header": header,
    "overall_rates": overall_rates,
    "profit_factor_overall": profit_factor_overall,
    **_per_horizon("perf_by_year", performance_by_year),
    **_per_horizon("perf_by_gap_size", performance_by_gap_size),
    "monthly_sma5": monthly_sma5,
    **_per_horizon("monthly_win", monthly_win),
    "monthly_win_both": monthly_win_both,
    "gap_histogram": gap_histogram,
    "gap_box": gap_box,
    "retrace_by_gap_bucket": retrace_by_gap_bucket,
    **_per_horizon("win_by_gap", win_by_gap),
    **_per_horizon("win_by_avwap_distance", win_by_avwap_distance),
    "win_above_below": win_above_below,
    "win_above_below_330": win_above_below_330,
    **_per_horizon("win_by_sma330", win_by_sma330),
    **_per_horizon("win_by_benchmark", win_by_benchmark),
    "trade_pnl": trade_pnl,
    "equity_curve": equity_curve,
    "pnl_totals": pnl_totals,
    "gap_retrace_points": gap_retrace_points,
    **_per_horizon("days_to_retrace", days_to_retrace),
    "benchmark_vs_retrace": benchmark_vs_retrace,
    "benchmark_trend": benchmark_trend,
    "top_mfe": top_mfe,
}
