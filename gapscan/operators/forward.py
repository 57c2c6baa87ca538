"""What happened after a bar: following bars, touches of a level, extremes, excursions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscan.functions.columns import BY_SYMBOL, WindowFeature, add, add_features
from gapscan.functions.prices import by_mode
from gapscan.schema import HORIZONS

FORWARD_BARS = max(HORIZONS)


def forward_columns(n: int = FORWARD_BARS) -> WindowFeature:
    """date_i, high_i and low_i of the i-th following bar, i = 1..n.

    Flat columns keep every later expression on them inside generated code.
    """
    return WindowFeature({
        f"{name}_{i}": f"lead({name}, {i}) over ({BY_SYMBOL})"
        for i in range(1, n + 1)
        for name in ("date", "high", "low")
    })


def with_forward(bars: DataFrame, n: int = FORWARD_BARS) -> DataFrame:
    return add_features(bars, [forward_columns(n)])


def forward_bars(df: DataFrame, n: int = FORWARD_BARS) -> DataFrame:
    """One row per bar and following bar, numbered rn = 1..n. Expects with_forward."""
    following = ", ".join(f"{i}, date_{i}, high_{i}, low_{i}" for i in range(1, n + 1))
    rows = df.selectExpr("symbol", "date", f"stack({n}, {following}) as (rn, forward_date, high, low)")
    return rows.where("forward_date is not null")


def _within(name: str, i: int, days: int | None) -> str:
    """The i-th following bar's column, null when it is more than `days` calendar days on."""
    column = f"{name}_{i}"
    return column if days is None else f"if(datediff(date_{i}, date) <= {days}, {column}, null)"


def lowest(n: int, days: int | None = None) -> str:
    return f"least({', '.join(_within('low', i, days) for i in range(1, n + 1))})"


def highest(n: int, days: int | None = None) -> str:
    return f"greatest({', '.join(_within('high', i, days) for i in range(1, n + 1))})"


def first_touch(level: str, mode: str, n: int, days: int | None = None) -> str:
    """Number of the first of the next n bars that comes back to the level, or null.

    An up gap comes back when a low is at or under the level, a down gap when a high
    is at or over it. With days, only bars at most that many calendar days on count;
    a bar per day is the most there is, so n = days bars cover them.
    """

    def first(side: str, comparison: str) -> str:
        hits = [f"case when {_within(side, i, days)} {comparison} {level} then {i} end" for i in range(1, n + 1)]
        return f"coalesce({', '.join(hits)})"

    return by_mode(mode, first("low", "<="), first("high", ">="))


def far_touch(df: DataFrame, level: str, mode: str, bars: int | None = None, days: int | None = None, name: str = "touch") -> DataFrame:
    """(symbol, date, touch): number of the first following bar that comes back to the level, at any horizon.

    Only rows with a level are returned; the touch is null without one among the next `bars` bars, or among those at most `days` calendar
    days on (one of the two is given). Each symbol's bars become sparse tables, the lowest low of the 1, 2, 4, ... bars
    from a bar on (for gaps down, the highest high), of which log2(horizon) suffice: a row steps
    over the widest stretches that do not touch, from the widest to the narrowest. A symbol has a bar per calendar day
    at most, which bounds its arrays. Bars must be unique; a low that is not known does not touch.
    """
    return far_touches(df, {mode: level}, bars, days, name).drop("mode")


def far_touches(df: DataFrame, levels: Mapping[str, str], bars: int | None = None, days: int | None = None, name: str = "touch") -> DataFrame:
    """(mode, symbol, date, touch): what `far_touch` finds for each mode's level, from one pass over the bars."""
    if not levels or not {"up", "down"} >= set(levels) or (bars is None) == (days is None) or (days if bars is None else bars) < 1:
        raise ValueError("give a mode, up or down, and a horizon of one bar or day at least")
    reach = str(bars) if bars else f"count(*) over ({BY_SYMBOL} range between interval 1 day following and interval {days} days following)"
    values = {}
    for mode, level in levels.items():
        sign, price = ("", "low") if mode == "up" else ("-", "high")
        values |= {f"_price_{mode}": f"{sign}{price}", f"_level_{mode}": f"{sign}({level})"}
    seen = df.selectExpr("symbol", "date", *[f"{sql} as {name}" for name, sql in values.items()], f"cast({reach} as int) as _reach")
    packed = seen.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", *values, "_reach"))).alias("_bars"))
    top = (bars or days).bit_length() - 1

    def stepped(mode: str) -> str:
        tables = (
            f"aggregate(sequence(1, {top + 1}), array(transform(_bars, b -> b._price_{mode})), (done, k) -> if(k > {top}, done, concat(done, array("
            "transform(element_at(done, -1), (x, j) -> least(x, get(element_at(done, -1), j + shiftleft(1, k - 1))))))))"
        )
        # a table lists stretches from each bar on; what is beyond the last bar, or unknown, is stepped over
        steps = (
            f"aggregate(sequence({top}, 0, -1), 0, (at, k) -> if(at + shiftleft(1, k) <= b._reach"
            f" and coalesce(get(get(t, k), i + 1 + at) > b._level_{mode}, true), at + shiftleft(1, k), at))"
        )
        # the tables are bound to a name, so that they are made once
        return (
            f"get(transform(array({tables}), t -> filter(transform(_bars, (b, i) -> if(b._level_{mode} is null, null, struct('{mode}' as mode, b.date as date,"
            f" transform(array({steps}), at -> if(at < b._reach and get(get(t, 0), i + 1 + at) <= b._level_{mode}, at + 1, null)) as found))), r -> r is not null)), 0)"
        )

    rows = packed.select("symbol", F.explode(F.expr(f"concat({', '.join(map(stepped, levels))})")).alias("_row"))
    return rows.select(F.col("_row.mode").alias("mode"), "symbol", F.col("_row.date").alias("date"), F.col("_row.found")[0].alias(name))


def with_forward_extremes(df: DataFrame) -> DataFrame:
    """Adds lowest_<h>d and highest_<h>d over the next h bars."""
    columns = {}
    for h in HORIZONS:
        columns |= {f"lowest_{h}d": lowest(h), f"highest_{h}d": highest(h)}
    return add(df, columns)


def _with_touch(df: DataFrame, touches: dict[int, str], retraced: str, days: str) -> DataFrame:
    found = add(df, {f"{days}_{h}d": touch for h, touch in touches.items()})
    return add(found, {f"{retraced}_{h}d": f"{days}_{h}d is not null" for h in touches})


def with_vwap_touch(df: DataFrame, mode: str) -> DataFrame:
    """Adds whether and on which bar price came back to the anchored VWAP."""
    touches = {h: first_touch("anchored_vwap", mode, h) for h in HORIZONS}
    return _with_touch(df, touches, "retraced_to_vwap", "days_to_retrace")


def with_ema_touch(df: DataFrame, mode: str) -> DataFrame:
    """Adds whether price came back to the 21-EMA within h calendar days, and on which bar."""
    touches = {h: first_touch("ema_21", mode, h, days=h) for h in HORIZONS}
    return _with_touch(df, touches, "retraced_to_21ema", "days_to_21ema")


def excursions(h: int) -> dict[str, str]:
    """Largest rise and fall from the close over the next h bars, 0 without bars."""
    moves = {"mfe": f"(highest_{h}d - close)", "mae": f"(close - lowest_{h}d)"}
    columns = {}
    for name, move in moves.items():
        columns[f"{name}_dollars_{h}d"] = f"coalesce(case when close > 0 then {move} end, 0D)"
        columns[f"{name}_percent_{h}d"] = f"coalesce(case when close > 0 then {move} / close * 100 end, 0D)"
    return columns


def _move_back(mode: str, h: int) -> str:
    """How far price came back from the open in h bars; null without bars."""
    back = by_mode(mode, f"open - lowest_{h}d", f"highest_{h}d - open")
    return f"case when {back} >= 0 then {back} when {back} < 0 then 0D end"


def retrace_percent(mode: str, h: int) -> dict[str, str]:
    """How much of the way from open to anchored VWAP was covered; may exceed 100."""
    way = by_mode(mode, "(open - anchored_vwap)", "(anchored_vwap - open)")
    covered = f"case when anchored_vwap > 0 and {way} > 0 then ({_move_back(mode, h)}) / {way} * 100 end"
    return {f"retrace_percentage_{h}d": f"coalesce({covered}, 0D)"}


def gap_closure(mode: str, h: int) -> dict[str, str]:
    """How much of the gap was closed, may exceed 100, and whether it was filled."""
    size = "abs(open - prev_close)"
    filled = by_mode(mode, f"lowest_{h}d <= prev_close", f"highest_{h}d >= prev_close")
    return {
        f"gap_closure_percentage_{h}d":
            f"coalesce(case when {size} > 0 then ({_move_back(mode, h)}) / {size} * 100 end, 0D)",
        f"gap_filled_{h}d": f"coalesce({size} > 0 and {filled}, false)",
    }


def with_excursions(df: DataFrame) -> DataFrame:
    return add(df, {name: sql for h in HORIZONS for name, sql in excursions(h).items()})


def with_retrace_percent(df: DataFrame, mode: str) -> DataFrame:
    return add(df, {name: sql for h in HORIZONS for name, sql in retrace_percent(mode, h).items()})


def with_gap_closure(df: DataFrame, mode: str) -> DataFrame:
    return add(df, {name: sql for h in HORIZONS for name, sql in gap_closure(mode, h).items()})


def retrace_from_open_calendar(df: DataFrame, days: int = 10) -> DataFrame:
    """Retrace of up gaps by calendar days: whether, after how many days, how far.

    Counts the days to the first low at or under the anchored VWAP. The percentage
    is 0 when the open is not above it and can be negative. Expects with_forward.
    """
    touches = [
        f"case when {_within('low', i, days)} <= anchored_vwap then datediff(date_{i}, date) end"
        for i in range(1, days + 1)
    ]
    percent = (
        f"case when open > anchored_vwap"
        f" then (open - {lowest(days, days)}) / (open - anchored_vwap) * 100 end"
    )
    found = add(df, {"days_to_retrace": f"coalesce({', '.join(touches)})"})
    return add(found, {
        "retraced": "days_to_retrace is not null",
        "retrace_percentage": f"coalesce({percent}, 0D)",
    })


def excursions_calendar(df: DataFrame, days: int = 10) -> DataFrame:
    """Largest rise and fall from the close in the next calendar days, 0 without bars."""
    moves = {"mfe": f"({highest(days, days)} - close)", "mae": f"(close - {lowest(days, days)})"}
    columns = {}
    for name, move in moves.items():
        columns[f"{name}_dollars"] = f"coalesce({move}, 0D)"
        columns[f"{name}_percent"] = f"coalesce(case when close > 0 then {move} / close * 100 end, 0D)"
    return add(df, columns)
