"""Opening gaps: previous close, anchored VWAP over three days, filters, rankings.

Windows by symbol run on de-duplicated bars, where a symbol has at most one row per
calendar day, so no partition of such a window can grow with the raw data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapscan.functions.columns import BY_SYMBOL, WindowFeature, add, add_features
from gapscan.functions.prices import VWAP_SUMS, by_mode, gap_percent, vwap

DEFAULT_THRESHOLD = 0.02
DEFAULT_ROOM = 0.02
PRICE_BAND = (20.0, 1000.0)

# The close of the bar before, null on a symbol's first bar.
PREV_CLOSE = WindowFeature({"prev_close": f"lag(close) over ({BY_SYMBOL})"})

# The VWAP from three calendar days before through the day itself.
_NEAR = {f"_near_{name}": sql for name, sql in VWAP_SUMS.items()}
AVWAP_3D = WindowFeature(
    windows={name: f"{sql} over ({BY_SYMBOL} range between 3 preceding and current row)" for name, sql in _NEAR.items()},
    columns={"anchored_vwap": vwap(*_NEAR)},
    scratch=tuple(_NEAR),
)


def with_prev_close(bars: DataFrame) -> DataFrame:
    return add_features(bars, [PREV_CLOSE])


def with_avwap_3d(bars: DataFrame) -> DataFrame:
    return add_features(bars, [AVWAP_3D])


def prev_close(bars: DataFrame) -> DataFrame:
    """Bars that have an earlier one, with its close."""
    return with_prev_close(bars).where("prev_close is not null")


def vwap_by_symbol(bars: DataFrame) -> DataFrame:
    """VWAP of all bars of each symbol."""
    sums = bars.groupBy("symbol").agg(*[F.expr(sql).alias(name) for name, sql in VWAP_SUMS.items()])
    return sums.selectExpr("symbol", f"{vwap(*VWAP_SUMS)} as vwap")


def find_gaps(
    bars: DataFrame,
    mode: str = "up",
    threshold: float = DEFAULT_THRESHOLD,
    min_price: float = PRICE_BAND[0],
    max_price: float = PRICE_BAND[1],
) -> DataFrame:
    """Bars opening at least the threshold away from the previous close.

    The previous close must lie in the price band, bounds included. Expects the
    prev_close column; adds gap_percent as a fraction.
    """
    if mode == "both" and threshold <= 0:
        raise ValueError("mode both needs a positive threshold, else a bar could gap both ways")
    return add(bars.where(is_gap(mode, threshold, min_price, max_price)), {"gap_percent": gap_percent(mode)})


def is_gap(mode: str = "up", threshold: float = DEFAULT_THRESHOLD, min_price: float = PRICE_BAND[0], max_price: float = PRICE_BAND[1]) -> str:
    return f"prev_close between {float(min_price)}D and {float(max_price)}D and {gap_percent(mode)} >= {float(threshold)}D"


def has_room(mode: str = "up", room: float = DEFAULT_ROOM) -> str:
    distance = by_mode(mode, "open - anchored_vwap", "anchored_vwap - open")
    return f"{distance} > 0 and {distance} >= {float(room)}D * prev_close"


def largest_first(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(F.desc("gap_percent"), "symbol", "date")


def avwap_room(gaps: DataFrame, mode: str = "up", room: float = DEFAULT_ROOM) -> DataFrame:
    """Gaps opening on the far side of the anchored VWAP, at least room x previous close away."""
    return gaps.where(has_room(mode, room))


def top_gaps_per_date(gaps: DataFrame, n: int = 5, size: str = "gap_percent", symbol: str = "symbol") -> DataFrame:
    """The n largest gaps of each date, ranked; for outcome tables name their columns."""
    largest = Window.partitionBy("date").orderBy(F.desc(size), symbol)
    return gaps.withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= n)
