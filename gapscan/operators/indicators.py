"""Indicators as of each bar: moving averages, EMA, quarter-anchored VWAPs, benchmark."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscan.functions.columns import BY_SYMBOL, WindowFeature, add, add_features, drop_scratch, merged
from gapscan.functions.prices import PRICE_UNITS, VWAP_SUMS, percent_from, price_units, vwap
from gapscan.schema import QUARTER_ANCHORS, SMA_PERIODS


@dataclass(frozen=True)
class Sma:
    """A simple moving average over the last `bars` bars.

    Null with fewer than min_bars bars; with within_days, also null unless the
    oldest of a full set of bars lies at most that many calendar days back.
    """

    bars: int
    min_bars: int
    within_days: int | None = None


STANDARD_SMAS = tuple(Sma(n, min_bars=n) for n in SMA_PERIODS)
SMA_330 = Sma(330, min_bars=1)
SMA_330_STRICT = Sma(330, min_bars=330, within_days=500)


def sma_distances(averages: Sequence[Sma] = STANDARD_SMAS) -> WindowFeature:
    """sma_<n>_distance_percent of the close for each average.

    An average is the difference of two running sums, so its cost does not depend on
    its length.
    """
    running = {
        "_closes": f"sum({price_units('close')}) over ({BY_SYMBOL})",
        "_priced": f"count(close) over ({BY_SYMBOL})",
    }
    windows = {"_bars": f"row_number() over ({BY_SYMBOL})"}
    columns = {}
    for a in averages:
        windows[f"_closes_{a.bars}"] = f"lag(_closes, {a.bars}) over ({BY_SYMBOL})"
        windows[f"_priced_{a.bars}"] = f"lag(_priced, {a.bars}) over ({BY_SYMBOL})"
        enough = f"_bars >= {a.min_bars}"
        if a.within_days is not None:
            windows[f"_oldest_{a.bars}"] = f"lag(date, {a.bars - 1}) over ({BY_SYMBOL})"
            enough += f" and datediff(date, _oldest_{a.bars}) <= {a.within_days}"
        total = f"(_closes - coalesce(_closes_{a.bars}, 0D))"
        priced = f"(_priced - coalesce(_priced_{a.bars}, 0))"
        average = f"({total} / (nullif({priced}, 0) * {PRICE_UNITS}D))"
        columns[f"sma_{a.bars}_distance_percent"] = f"case when {enough} then {percent_from(average)} end"
    return WindowFeature(windows, columns, running, scratch=(*running, *windows))


def with_sma_distances(bars: DataFrame, averages: Sequence[Sma] = STANDARD_SMAS) -> DataFrame:
    return add_features(bars, [sma_distances(averages)])


#: Closes that an EMA starts from at most.
EMA_BARS = 50


def ema(span: int = 21, max_bars: int = EMA_BARS, min_bars: int = 21) -> WindowFeature:
    """ema_<span>, recursive from the oldest of the last max_bars closes.

    Null with fewer than min_bars bars. The fold is a plain projection over the
    window's list of closes, so it runs only on rows that survive later filters.
    """
    alpha = 2.0 / (span + 1)
    recent = f"{BY_SYMBOL} rows between {max_bars - 1} preceding and current row"
    step = f"(acc, x) -> if(acc is null, x, acc * {1 - alpha!r}D + x * {alpha!r}D)"
    return WindowFeature(
        windows={
            "_ema_closes": f"collect_list(close) over ({recent})",
            "_ema_bars": f"count(1) over ({recent})",
        },
        columns={
            f"ema_{span}": f"case when _ema_bars >= {min_bars}"
                           f" then aggregate(_ema_closes, cast(null as double), {step}) end"
        },
        scratch=("_ema_closes", "_ema_bars"),
    )


def with_ema(bars: DataFrame, span: int = 21, max_bars: int = EMA_BARS, min_bars: int = 21) -> DataFrame:
    return add_features(bars, [ema(span, max_bars, min_bars)])


def full_ema(bars: DataFrame, span: int = 21, min_bars: int = 1, name: str = "ema") -> DataFrame:
    """(symbol, date, ema): the recursive average of closes over each symbol's whole history, from its first known close on.

    A quarter's bars take the average y it starts with to A * y + B, one after the other, so a quarter is such a map itself. Within quarters
    all bars are worked out in parallel, as if y were 0, by sums of closes weighted by powers that stay small for a quarter's 92 days
    (spans of 5 and more). Only the maps of quarters are then composed in order, a row a quarter, and each quarter gets the y it starts with. So a
    symbol with most bars is spread over its quarters. A close that is not known leaves the average as it is; before the first one, and before
    `min_bars` bars, there is none. Bars are unique; one without a date belongs to no history and is left out.
    """
    if span < 5:
        raise ValueError("spans under 5 lose precision over a quarter")
    keep = 1 - 2 / (span + 1)
    quarter = "partition by symbol, _quarter order by date"
    dated = add(bars.where("date is not null").select("symbol", "date", "close"), {"_quarter": "trunc(date, 'quarter')"})
    dated = dated.repartition("symbol", "_quarter")
    # _k closes are known so far in the quarter, the current one included
    counted = add(dated, {"_k": f"count(close) over ({quarter})", "_bars": f"count(*) over ({quarter})"})
    local = add(counted, {"_sum": f"sum(close * pow({keep!r}D, 0 - _k)) over ({quarter})"})
    local = add(local, {"_own": f"coalesce({1 - keep!r}D * pow({keep!r}D, _k) * _sum, 0D)"})
    ends = local.groupBy("symbol", "_quarter").agg(
        F.max(F.struct("date", "_k", "_bars", "_own")).alias("_end"), F.min_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("_first")
    )
    # a symbol has four quarters a year: their maps in order, from the first known close on
    steps = ends.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_quarter", "_end", "_first"))).alias("_quarters"))
    seeded = "coalesce(s.y, q._first)"
    composed = (
        "aggregate(_quarters, named_struct('y', cast(null as double), 'bars', 0L, 'starts',"
        " cast(array() as array<struct<_quarter:date,y:double,begun:boolean,before:bigint>>)),"
        f" (s, q) -> named_struct('y', pow({keep!r}D, q._end._k) * {seeded} + q._end._own, 'bars', s.bars + q._end._bars,"
        f" 'starts', concat(s.starts, array(struct(q._quarter as _quarter, {seeded} as y, s.y is not null as begun, s.bars as before)))), s -> s.starts)"
    )
    starts = steps.select("symbol", F.explode(F.expr(composed)).alias("_s")).select("symbol", "_s._quarter", "_s.y", "_s.begun", "_s.before")
    placed = local.join(starts, ["symbol", "_quarter"])
    # before the first known close there is no average yet
    value = f"pow({keep!r}D, _k) * y + _own"
    return placed.selectExpr("symbol", "date", f"case when (_k > 0 or begun) and before + _bars >= {int(min_bars)} then {value} end as {name}")


def anchor_dates(dates: DataFrame) -> DataFrame:
    """For each date, the dates its anchored VWAPs start from."""
    return dates.selectExpr(
        "date",
        *[f"date_sub(trunc(date, 'quarter'), {back}) as anchor_{name}" for name, back in QUARTER_ANCHORS.items()],
    )


def _with_quarter_markers(bars: DataFrame, dates_of: DataFrame | None) -> DataFrame:
    """The bars plus a marker row without prices on the first day of each symbol's quarters."""
    if dates_of is not None:
        quarters = dates_of.selectExpr("symbol", "trunc(date, 'quarter') as date").distinct()
        return add(bars, {"_marker": "false"}).unionByName(
            add(quarters, {"_marker": "true"}), allowMissingColumns=True
        )
    opens = f"coalesce(trunc(lag(date) over ({BY_SYMBOL}), 'quarter') < trunc(date, 'quarter'), true)"
    doubled = add(bars, {"_opens": opens}).selectExpr("*", "explode(if(_opens, array(true, false), array(false))) as _marker")
    values = [name for name in bars.columns if name not in ("symbol", "date")]
    return doubled.selectExpr(
        "symbol",
        "if(_marker, trunc(date, 'quarter'), date) as date",
        *[f"if(_marker, null, {name}) as {name}" for name in values],
        "_marker",
    )


def with_anchored_vwap_distances(
    bars: DataFrame,
    features: Iterable[WindowFeature] = (),
    dates_of: DataFrame | None = None,
) -> DataFrame:
    """Adds avwap_<anchor>_distance_percent of the close for the quarter anchors.

    All days of a quarter share their anchors. So each symbol and quarter gets one
    marker row on the quarter's first day; there a range frame ending a fixed number
    of days back finds the running sums from before an anchor. A VWAP since an anchor
    is the running sums of the day less those. That needs no join and no pairs of
    bars, only a few passes over a symbol's bars. Further features share the passes.

    Bars that are to be shuffled by symbol anyway best come with dates_of, a table to
    read the symbols' quarters off, such as the raw bars: the markers then join before
    the sort. Without it they are made from the sorted bars, which keeps a partitioning
    by symbol the bars already have and costs a second, local sort.
    """
    features = list(features)
    names = list(bars.columns)
    marked = _with_quarter_markers(bars, dates_of)
    # Rows of one date are peers in these frames, so the bar and the marker of a
    # quarter's first day have the same running sums.
    totals = {f"_{name}": f"{sql} over ({BY_SYMBOL})" for name, sql in VWAP_SUMS.items()}
    summed = add(marked, totals | merged(features, "running"))
    packed = add(summed, {"_sums": f"struct({', '.join(totals)})"}).drop(*totals)
    before = add(packed, {
        f"_at_{name}": f"last(_sums) over ({BY_SYMBOL} range between unbounded preceding and {back + 1} preceding)"
        for name, back in QUARTER_ANCHORS.items()
    })
    at_anchors = ", ".join(f"_at_{name}" for name in QUARTER_ANCHORS)
    carried = add(before, {
        "_anchors": f"last(if(_marker, array({at_anchors}), null), true) over ({BY_SYMBOL})"
    }).where("not _marker")
    windowed = add(
        carried.select(*names, *merged(features, "running"), "_sums", "_anchors"), merged(features, "windows")
    )

    # What follows is plain projection, so filters on the windows go first.
    since = vwap(*[f"(_sums.{total} - coalesce(a.{total}, 0))" for total in totals])
    averaged = add(windowed, {"_avwaps": f"transform(_anchors, a -> {since})"})
    distances = {f"avwap_{name}_distance_percent": percent_from(f"_avwaps[{i}]")
                 for i, name in enumerate(QUARTER_ANCHORS)}
    measured = add(averaged, distances | merged(features, "columns"))
    return drop_scratch(measured.drop("_sums", "_anchors", "_avwaps"), features)


def benchmark_gains(bars: DataFrame, symbol: str = "SPY") -> DataFrame:
    """Percent change of the benchmark's close on each of its dates but the first."""
    closes = add(bars.where(F.col("symbol") == symbol), {"before": f"lag(close) over ({BY_SYMBOL})"})
    return closes.where("before is not null").selectExpr(
        "date", "(close - before) / nullif(before, 0D) * 100 as spy_daily_gain_percent"
    )


def with_benchmark_gain(gaps: DataFrame, bars: DataFrame, symbol: str = "SPY") -> DataFrame:
    """Adds the benchmark's gain on the date, null when it has none.

    The benchmark is one symbol of de-duplicated bars, at most one row per calendar
    day, so broadcasting it is safe at any data size.
    """
    return gaps.join(F.broadcast(benchmark_gains(bars, symbol)), "date", "left")
