"""The gap outcome table: one wide row per symbol and gap day, for all dates at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscan.functions.columns import add, add_features
from gapscan.functions.prices import by_mode
from gapscan.operators import forward, gaps, indicators
from gapscan.operators.indicators import SMA_330, STANDARD_SMAS, Sma
from gapscan.schema import HORIZONS, OUTCOME_COLUMNS, QUARTER_ANCHORS
from gapscan.sources.bars import around_dates, dedupe_bars


def candidate_gaps(
    unique_bars: DataFrame,
    mode: str = "up",
    threshold: float = gaps.DEFAULT_THRESHOLD,
    room: float = gaps.DEFAULT_ROOM,
    min_price: float = gaps.PRICE_BAND[0],
    max_price: float = gaps.PRICE_BAND[1],
) -> DataFrame:
    """Gaps with room to the anchored VWAP."""
    priced = add_features(unique_bars, [gaps.PREV_CLOSE, gaps.AVWAP_3D])
    found = gaps.find_gaps(priced, mode, threshold, min_price, max_price)
    return gaps.avwap_room(found, mode, room)


def gap_touches(bars: DataFrame, mode: str = "up", deduplicate: bool = True, **settings) -> DataFrame:
    """(ticker, date, whether and on which bar price came back to the VWAP): what summaries by date need, without any indicator."""
    unique = dedupe_bars(bars) if deduplicate else bars
    described = add_features(unique, [gaps.PREV_CLOSE, gaps.AVWAP_3D, forward.forward_columns()])
    room = settings.pop("room", gaps.DEFAULT_ROOM)
    limits = (settings.pop(k, d) for k, d in (("threshold", gaps.DEFAULT_THRESHOLD), ("min_price", gaps.PRICE_BAND[0]), ("max_price", gaps.PRICE_BAND[1])))
    found = gaps.avwap_room(gaps.find_gaps(described, mode, *limits), mode, room)
    if settings:
        raise TypeError(f"unknown settings {sorted(settings)}")
    touched = forward.with_vwap_touch(found, mode)
    return touched.select(F.col("symbol").alias("ticker"), "date", *[f"{c}_{h}d" for h in HORIZONS for c in ("retraced_to_vwap", "days_to_retrace")])


def gap_outcomes(
    bars: DataFrame,
    mode: str = "up",
    start: str | None = None,
    end: str | None = None,
    *,
    threshold: float = gaps.DEFAULT_THRESHOLD,
    room: float = gaps.DEFAULT_ROOM,
    min_price: float = gaps.PRICE_BAND[0],
    max_price: float = gaps.PRICE_BAND[1],
    sma_330: Sma = SMA_330,
    benchmark: str = "SPY",
    exclude: Sequence[str] = (),
    deduplicate: bool = True,
) -> DataFrame:
    """Outcomes of the gaps in [start, end], in full precision, with their direction.

    Mode up looks at gaps up (traded short), down at gaps down (traded long), both at
    the two in one pass. All indicators and forward bars come from windows over one
    partitioning by symbol; rows that are no gap leave right after them. Bars known to
    be unique per symbol and date can skip the de-duplication.

    With dates, only the bars that their measures can look at are read into the windows.
    """
    if start is not None or end is not None:
        lookback = max(sma_330.bars, *(a.bars for a in STANDARD_SMAS), indicators.EMA_BARS)
        bars = around_dates(bars, start, end, max(QUARTER_ANCHORS.values()), lookback, max(HORIZONS))
    unique = dedupe_bars(bars) if deduplicate else bars
    described = indicators.with_anchored_vwap_distances(
        unique,
        features=[
            gaps.PREV_CLOSE,
            gaps.AVWAP_3D,
            indicators.sma_distances((*STANDARD_SMAS, sma_330)),
            indicators.ema(),
            forward.forward_columns(),
        ],
    )
    found = gaps.find_gaps(described, mode, threshold, min_price, max_price)
    found = gaps.avwap_room(found, mode, room)
    if start is not None:
        found = found.where(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        found = found.where(F.col("date") <= F.to_date(F.lit(end)))
    if exclude:
        found = found.where(~F.col("symbol").isin(*exclude))

    followed = forward.with_ema_touch(forward.with_vwap_touch(forward.with_forward_extremes(found), mode), mode)
    measured = {name: sql for h in HORIZONS
                for part in (forward.excursions(h), forward.retrace_percent(mode, h), forward.gap_closure(mode, h))
                for name, sql in part.items()}
    named = add(followed, measured | {
        "ticker": "symbol",
        "gap_up_percent": "gap_percent * 100",
        "open_price": "open",
        "close_price": "close",
        "direction": by_mode(mode, "'short'", "'long'"),
    })
    compared = indicators.with_benchmark_gain(named, unique, benchmark)
    return compared.select(*OUTCOME_COLUMNS, "direction")
