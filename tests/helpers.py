"""Small bar tables and a plain per-row restatement of the outcome rules."""

from __future__ import annotations

import datetime as dt
import math
import random

BAR_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume bigint"


def day(n: int, start: dt.date = dt.date(2020, 1, 1)) -> dt.date:
    return start + dt.timedelta(days=n)


def bar(symbol, n, open, high=None, low=None, close=None, volume=100):
    close = open if close is None else close
    high = max(open, close) if high is None else high
    low = min(open, close) if low is None else low
    return (symbol, day(n), float(open), float(high), float(low), float(close), volume)


def frame(spark, bars):
    return spark.createDataFrame(bars, BAR_SCHEMA)


def rows_by(df, *keys):
    rows = df.collect()
    result = {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
    assert len(result) == len(rows)
    return result


def random_bars(seed: int, symbols=("A", "B", "SPY"), days: int = 420):
    """Jumping prices with missing days, duplicates and bars without volume."""
    rng = random.Random(seed)
    bars = []
    for symbol in symbols:
        price = rng.randint(4000, 9000)
        for n in range(days):
            if rng.random() < 0.35:
                continue
            price = max(1500, price + rng.choice((0, 0, 0, 150, -150, 400, -400)))
            for _ in range(1 + (rng.random() < 0.1)):
                o, c = price + rng.randint(-120, 120), price + rng.randint(-120, 120)
                high, low = max(o, c) + rng.randint(0, 90), min(o, c) - rng.randint(0, 90)
                volume = rng.choice((0, 0, 10, 20, 35, 50, None))
                bars.append((symbol, day(n), o / 100, high / 100, low / 100, c / 100, volume))
    return bars


def brute_outcomes(bars, up: bool, threshold=0.02, room=0.02):
    """Outcome rows per (symbol, date), worked out bar by bar."""
    unique = {}
    for b in bars:
        rank = (b[6] or 0, b[2], b[5], b[3], b[4])
        if (b[0], b[1]) not in unique or rank > unique[b[0], b[1]][0]:
            unique[b[0], b[1]] = (rank, b)
    history = {}
    for (symbol, date), (_, b) in sorted(unique.items()):
        history.setdefault(symbol, []).append(dict(date=date, open=b[2], high=b[3], low=b[4], close=b[5], vol=b[6] or 0))

    def vwap(part):
        typical = [(x["high"] + x["low"] + x["close"]) / 3 for x in part]
        volume = sum(x["vol"] for x in part)
        if volume:
            return sum(t * x["vol"] for t, x in zip(typical, part)) / volume
        return sum(typical) / len(typical)

    gain = {}
    for before, now in zip(history.get("SPY", []), history.get("SPY", [])[1:]):
        gain[now["date"]] = (now["close"] - before["close"]) / before["close"] * 100

    found = {}
    for symbol, path in history.items():
        for i, now in enumerate(path):
            if i == 0:
                continue
            prev = path[i - 1]["close"]
            o, c, d = now["open"], now["close"], now["date"]
            gap = (o - prev if up else prev - o) / prev
            if not 20 <= prev <= 1000 or gap < threshold:
                continue
            level = vwap([x for x in path[: i + 1] if x["date"] >= d - dt.timedelta(days=3)])
            way = o - level if up else level - o
            if way <= 0 or way < room * prev:
                continue
            row = dict(gap_up_percent=gap * 100, open_price=o, close_price=c, anchored_vwap=level)
            after = path[i + 1: i + 11]

            def touches(x, price):
                return x["low"] <= price if up else x["high"] >= price

            recent = [x["close"] for x in path[max(0, i - 49): i + 1]]
            ema = None
            if len(recent) >= 21:
                ema = recent[0]
                for x in recent[1:]:
                    ema = ema * (1 - 2 / 22) + x * 2 / 22
            row["ema_21"] = ema
            for h in (5, 10):
                ahead = after[:h]
                hits = [k for k, x in enumerate(ahead, 1) if touches(x, level)]
                low = min((x["low"] for x in ahead), default=None)
                high = max((x["high"] for x in ahead), default=None)
                back = max(0.0, o - low if up else high - o) if ahead else None
                row |= {
                    f"retraced_to_vwap_{h}d": bool(hits),
                    f"days_to_retrace_{h}d": hits[0] if hits else None,
                    f"retrace_percentage_{h}d": back / way * 100 if ahead else 0.0,
                    f"gap_closure_percentage_{h}d": back / abs(o - prev) * 100 if ahead else 0.0,
                    f"gap_filled_{h}d": bool(ahead) and (low <= prev if up else high >= prev),
                    f"mfe_dollars_{h}d": high - c if ahead else 0.0,
                    f"mae_dollars_{h}d": c - low if ahead else 0.0,
                    f"mfe_percent_{h}d": (high - c) / c * 100 if ahead else 0.0,
                    f"mae_percent_{h}d": (c - low) / c * 100 if ahead else 0.0,
                }
                soon = [x for x in path[i + 1:] if x["date"] <= d + dt.timedelta(days=h)]
                hits = [k for k, x in enumerate(soon, 1) if ema is not None and touches(x, ema)]
                row |= {f"retraced_to_21ema_{h}d": bool(hits), f"days_to_21ema_{h}d": hits[0] if hits else None}
            for n in (21, 50, 100, 200, 330):
                closes = [x["close"] for x in path[max(0, i + 1 - n): i + 1]]
                average = sum(closes) / len(closes)
                enough = len(closes) == n or n == 330
                row[f"sma_{n}_distance_percent"] = (c - average) / average * 100 if enough else None
            quarter = dt.date(d.year, (d.month - 1) // 3 * 3 + 1, 1)
            for name, back in (("current", 0), ("2q_ago", 180), ("3q_ago", 270), ("1y_ago", 365)):
                since = quarter - dt.timedelta(days=back)
                average = vwap([x for x in path[: i + 1] if x["date"] >= since])
                row[f"avwap_{name}_distance_percent"] = (c - average) / average * 100
            row["spy_daily_gain_percent"] = gain.get(d)
            found[symbol, d] = row
    return found


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b
