"""Column lists of the bar and outcome tables."""

from __future__ import annotations

BAR_COLUMNS = {
    "symbol": "string",
    "date": "date",
    "open": "double",
    "high": "double",
    "low": "double",
    "close": "double",
    "volume": "bigint",
}

HORIZONS = (5, 10)
SMA_PERIODS = (21, 50, 100, 200)

# Anchor name -> days before the first day of the gap day's quarter.
QUARTER_ANCHORS = {"current": 0, "2q_ago": 180, "3q_ago": 270, "1y_ago": 365}


def _horizon_columns(days: int) -> dict[str, str]:
    return {
        f"retraced_to_vwap_{days}d": "boolean",
        f"days_to_retrace_{days}d": "int",
        f"retrace_percentage_{days}d": "double",
        f"gap_closure_percentage_{days}d": "double",
        f"gap_filled_{days}d": "boolean",
        f"mfe_dollars_{days}d": "double",
        f"mae_dollars_{days}d": "double",
        f"mfe_percent_{days}d": "double",
        f"mae_percent_{days}d": "double",
    }


def _outcome_columns() -> dict[str, str]:
    columns = {
        "ticker": "string",
        "date": "date",
        "gap_up_percent": "double",
        "open_price": "double",
        "close_price": "double",
        "anchored_vwap": "double",
    }
    for days in HORIZONS:
        columns |= _horizon_columns(days)
    columns["ema_21"] = "double"
    for days in HORIZONS:
        columns |= {f"retraced_to_21ema_{days}d": "boolean", f"days_to_21ema_{days}d": "int"}
    columns |= {f"sma_{n}_distance_percent": "double" for n in (*SMA_PERIODS, 330)}
    columns |= {f"avwap_{name}_distance_percent": "double" for name in QUARTER_ANCHORS}
    columns["spy_daily_gain_percent"] = "double"
    return columns


# The 39 published columns, in file order.
OUTCOME_COLUMNS = _outcome_columns()

# Names older outcome files use for a column of today.
LEGACY_NAMES = {
    "retraced_to_vwap_10d": "retraced_to_vwap",
    "retrace_percentage_10d": "retrace_percentage",
    "mfe_percent_10d": "mfe_percent",
}
