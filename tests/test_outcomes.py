import datetime as dt
import random

import pytest

from gapscan.functions import prices
from gapscan.operators import forward, gaps, indicators
from gapscan.operators.gaps import add_features
from gapscan.plans.outcomes import gap_outcomes
from gapscan.plans.summaries import summary_by_date, summary_overall
from gapscan.schema import OUTCOME_COLUMNS
from gapscan.sources.bars import around_dates, bars_of, dedupe_bars, save_bucketed, trading_dates

from helpers import bar, brute_outcomes, close, day, frame, random_bars, rows_by


@pytest.mark.parametrize("mode", ["up", "down"])
@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes_equal_brute_force(spark, mode, seed):
    bars = random_bars(seed)
    expected = brute_outcomes(bars, up=mode == "up")
    table = gap_outcomes(frame(spark, bars), mode)
    assert table.columns == [*OUTCOME_COLUMNS, "direction"]
    assert {f.name: f.dataType.simpleString() for f in table.schema.fields if f.name != "direction"} == OUTCOME_COLUMNS
    found = rows_by(table, "ticker", "date")
    assert found.keys() == expected.keys() and len(found) > 20
    for key, row in expected.items():
        wrong = {n: (found[key][n], v) for n, v in row.items() if not close(found[key][n], v)}
        assert not wrong, (key, wrong)


def test_both_modes_in_one_pass(spark):
    bars = frame(spark, random_bars(3))
    both = {tuple(r) for r in gap_outcomes(bars, "both").collect()}
    apart = {tuple(r) for mode in ("up", "down") for r in gap_outcomes(bars, mode).collect()}
    assert both == apart and len(both) > 40


def test_row_order_and_worse_copies_change_nothing(spark):
    bars = random_bars(4)
    shuffled = bars[:]
    random.Random(0).shuffle(shuffled)
    copies = [(s, d, o * 2, h * 2, l, c, (v or 0) - 1) for s, d, o, h, l, c, v in bars]
    plain = sorted(map(tuple, gap_outcomes(frame(spark, bars), "up").collect()), key=repr)
    assert plain == sorted(map(tuple, gap_outcomes(frame(spark, shuffled + copies), "up").collect()), key=repr)


def test_longer_horizon_contains_shorter(spark):
    for r in gap_outcomes(frame(spark, random_bars(5)), "both").collect():
        if r.retraced_to_vwap_5d:
            assert r.retraced_to_vwap_10d and r.days_to_retrace_10d == r.days_to_retrace_5d
        assert r.mfe_dollars_10d >= r.mfe_dollars_5d or r.mfe_dollars_5d == 0


def test_up_mirrors_down(spark):
    bars = [b for b in random_bars(6, symbols=("A",)) if b[6]]
    mirrored = [(s, d, 200 - o, 200 - l, 200 - h, 200 - c, v) for s, d, o, h, l, c, v in bars]

    def touches(table, mode, level):
        described = forward.with_forward(dedupe_bars(frame(spark, table))).withColumn("level", level)
        touched = described.selectExpr("symbol", "date", f"{forward.first_touch('level', mode, 10)} as k")
        return rows_by(touched, "symbol", "date")

    from pyspark.sql import functions as F

    # Copies of a bar may be chosen differently once mirrored, so take one per day.
    one = list({(b[0], b[1]): b for b in bars}.values())
    one_mirrored = list({(b[0], b[1]): b for b in mirrored}.values())
    down = touches(one_mirrored, "down", F.col("close") + 1.0)
    up = touches(one, "up", F.col("close") - 1.0)
    assert {k: r.k for k, r in up.items()} == {k: r.k for k, r in down.items()}


def test_dedupe_prefers_volume_then_price(spark):
    bars = [
        bar("A", 0, 50, volume=5), bar("A", 0, 40, volume=9), bar("A", 0, 60, volume=None),
        bar("B", 0, 50, volume=5), bar("B", 0, 51, volume=5), bar("B", 0, 51, close=52, volume=5),
    ]
    found = rows_by(dedupe_bars(frame(spark, bars)), "symbol")
    assert found["A"].open == 40 and (found["B"].open, found["B"].close) == (51, 52)


def test_dedupe_limits_groups_before_the_shuffle(spark):
    plan = dedupe_bars(frame(spark, [bar("A", 0, 50)]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_bounds_are_inclusive(spark):
    bars = []
    for symbol, prev, open_ in [
        ("at20", 20, 21), ("under20", 19.99, 21), ("at1000", 1000, 1100), ("over1000", 1000.01, 1100),
        ("gap2", 100, 102), ("gap199", 100, 101.99),
    ]:
        bars += [bar(symbol, 0, prev), bar(symbol, 9, open_, close=prev)]
    found = gaps.find_gaps(gaps.with_prev_close(frame(spark, bars)), "up")
    assert set(rows_by(found, "symbol")) == {"at20", "at1000", "gap2"}
    first = rows_by(gaps.prev_close(frame(spark, bars)), "symbol")
    assert all(r.date == day(9) for r in first.values())


def test_room_is_inclusive_and_one_sided(spark):
    rows = [("exact", 102.0, 100.0), ("short", 101.99, 100.0), ("other side", 98.0, 100.0)]
    table = spark.createDataFrame([(s, o, 100.0, v) for s, o, v in rows], "symbol string, open double, prev_close double, anchored_vwap double")
    assert set(rows_by(gaps.avwap_room(table, "up"), "symbol")) == {"exact"}
    assert set(rows_by(gaps.avwap_room(table, "down"), "symbol")) == {"other side"}


def test_vwap_without_volume_is_the_mean(spark):
    bars = [bar("A", 0, 30, volume=0), bar("A", 1, 60, volume=None), bar("B", 0, 30, volume=1), bar("B", 1, 60, volume=3)]
    found = rows_by(gaps.with_avwap_3d(dedupe_bars(frame(spark, bars))), "symbol", "date")
    assert found["A", day(1)].anchored_vwap == 45 and found["B", day(1)].anchored_vwap == 52.5
    assert {r.symbol: r.vwap for r in gaps.vwap_by_symbol(frame(spark, bars)).collect()} == {"A": 45, "B": 52.5}


def test_avwap_window_is_four_calendar_days(spark):
    bars = [bar("A", n, p, volume=1) for n, p in ((0, 10), (1, 20), (4, 30))]
    found = rows_by(gaps.with_avwap_3d(frame(spark, bars)), "date")
    assert found[day(4)].anchored_vwap == 25


def test_no_forward_bars(spark):
    bars = [bar("A", 0, 100), bar("A", 30, 110, high=110, low=100, close=101)]
    (row,) = gap_outcomes(frame(spark, bars), "up").collect()
    assert row.retraced_to_vwap_10d is False and row.days_to_retrace_10d is None
    assert row.retrace_percentage_5d == row.gap_closure_percentage_10d == row.mfe_percent_5d == row.mae_dollars_10d == 0.0
    assert row.gap_filled_5d is False and row.ema_21 is None and row.spy_daily_gain_percent is None


def test_null_low_keeps_ordinals(spark):
    bars = [bar("A", 0, 100), bar("A", 30, 110, high=110, low=100, close=101), bar("A", 31, 109),
            ("A", day(32), 108.0, 108.0, None, 108.0, 1), bar("A", 33, 50)]
    (row,) = gap_outcomes(frame(spark, bars), "up", end="2020-01-31").collect()
    assert row.days_to_retrace_5d == 3 and row.mae_dollars_5d == 51


def test_bar_and_calendar_horizons_differ(spark):
    history = [bar("A", n, 100) for n in range(30)]
    gap = bar("A", 36, 110, high=110, low=100, close=101)
    after = [bar("A", 42, 109), bar("A", 46, 99)]
    (row,) = gap_outcomes(frame(spark, history + [gap] + after), "up").collect()
    assert row.retraced_to_vwap_5d and row.days_to_retrace_5d == 2
    assert not row.retraced_to_21ema_5d and row.days_to_21ema_5d is None
    assert row.retraced_to_21ema_10d and row.days_to_21ema_10d == 2


@pytest.mark.parametrize("n, known", [(20, False), (21, True), (50, True), (51, True)])
def test_ema_length(spark, n, known):
    closes = [100.0 + (i * 37 % 11) for i in range(n)]
    table = indicators.with_ema(frame(spark, [bar("A", i, c) for i, c in enumerate(closes)]))
    last = rows_by(table, "date")[day(n - 1)].ema_21
    if not known:
        assert last is None
        return
    expected = closes[-50:][0]
    for x in closes[-50:][1:]:
        expected = expected * (20 / 22) + x * (2 / 22)
    assert close(last, expected)


def test_sma_330_strict(spark):
    bars = [bar("A", n, 100 + n % 7) for n in range(331)] + [bar("B", 2 * n, 100 + n % 7) for n in range(331)]
    loose = rows_by(indicators.with_sma_distances(frame(spark, bars), [indicators.SMA_330]), "symbol", "date")
    strict = rows_by(indicators.with_sma_distances(frame(spark, bars), [indicators.SMA_330_STRICT]), "symbol", "date")
    column = "sma_330_distance_percent"
    assert all(r[column] is not None for r in loose.values())
    assert strict["A", day(328)][column] is None
    assert strict["A", day(330)][column] == loose["A", day(330)][column]
    assert all(r[column] is None for (s, _), r in strict.items() if s == "B")


def test_dates_and_exclusion(spark):
    bars = frame(spark, random_bars(7))
    everything = gap_outcomes(bars, "up").collect()
    cut = dt.date(2020, 6, 1)
    part = gap_outcomes(bars, "up", end="2020-06-01", exclude=["SPY"]).collect()
    assert {tuple(r) for r in part} == {tuple(r) for r in everything if r.date <= cut and r.ticker != "SPY"}
    assert 0 < len(part) < len(everything)
    with pytest.raises(ValueError):
        gap_outcomes(bars, "both", threshold=0.0)
    with pytest.raises(ValueError):
        gap_outcomes(bars, "sideways")


def test_calendar_variants(spark):
    bars = frame(spark, [bar("A", 0, 100), bar("A", 1, 110), bar("A", 4, 109), bar("A", 12, 90)])
    described = add_features(bars, [gaps.PREV_CLOSE, gaps.AVWAP_3D, forward.forward_columns()])
    row = rows_by(forward.retrace_from_open_calendar(described), "date")[day(1)]
    assert (row.anchored_vwap, row.retraced, row.days_to_retrace) == (105, False, None)
    assert close(row.retrace_percentage, 20.0)
    row = rows_by(forward.excursions_calendar(described), "date")[day(1)]
    assert (row.mfe_dollars, row.mae_dollars) == (-1, 1)
    wide = rows_by(forward.retrace_from_open_calendar(forward.with_forward(
        gaps.with_avwap_3d(bars), 11), days=11), "date")[day(1)]
    assert wide.retraced and wide.days_to_retrace == 11


def test_forward_bars_and_extremes(spark):
    bars = frame(spark, [bar("A", n, 100 + n) for n in range(13)])
    described = forward.with_forward(bars)
    listed = forward.forward_bars(described).where("date = date'2020-01-01'").orderBy("rn").collect()
    assert [(r.rn, r.forward_date) for r in listed] == [(n, day(n)) for n in range(1, 11)]
    row = rows_by(forward.with_forward_extremes(described), "date")[day(0)]
    assert (row.lowest_5d, row.highest_5d, row.highest_10d) == (101, 105, 110)


def test_rankings_and_restriction(spark):
    bars = [b for s in range(8) for b in (bar(f"S{s}", 0, 100), bar(f"S{s}", 9, 103 + s % 4, low=99, close=99))]
    table = frame(spark, bars)
    found = gaps.find_gaps(gaps.with_prev_close(table), "up")
    assert [r.symbol for r in gaps.largest_first(found).collect()][:3] == ["S3", "S7", "S2"]
    top = gaps.top_gaps_per_date(found, 3).orderBy("rank").collect()
    assert [(r.symbol, r["rank"]) for r in top] == [("S3", 1), ("S7", 2), ("S2", 3)]
    assert bars_of(table, found.where("symbol < 'S2'")).count() == 4


def test_trading_dates_and_summaries(spark):
    bars = frame(spark, [bar("A", 0, 100), bar("A", 30, 110, low=100, close=101), bar("A", 31, 90), bar("A", 90, 90)])
    dates = trading_dates(bars, "2020-01-01", "2020-02-01")
    assert [r.date for r in dates.collect()] == [day(0), day(30), day(31)]
    assert trading_dates(bars).count() == 0
    by_date = summary_by_date(gap_outcomes(bars, "up"), dates)
    assert [tuple(r)[1:] for r in by_date.collect()] == [(0, 0, 0.0, 0, 0.0), (1, 1, 100.0, 1, 100.0), (0, 0, 0.0, 0, 0.0)]
    assert tuple(summary_overall(by_date).collect()[0]) == (1, 1, 100.0, 1, 100.0)
    assert tuple(summary_overall(by_date.where("false")).collect()[0]) == (0, 0, 0.0, 0, 0.0)


def test_bucketed_bars_need_no_shuffle(spark):
    bars = frame(spark, random_bars(8))
    save_bucketed(dedupe_bars(bars), "bars_by_symbol", 4)
    outcomes = gap_outcomes(spark.table("bars_by_symbol"), "up", deduplicate=False)
    plan = outcomes._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan
    assert sorted(map(tuple, outcomes.collect()), key=repr) == sorted(map(tuple, gap_outcomes(bars, "up").collect()), key=repr)


def sparse_bars(seed: int):
    """Random bars, a symbol with a bar a month, one with six-day gaps, one that ends early, and one without a date."""
    bars = random_bars(seed, days=900)
    bars += [bar("MONTHLY", 30 * i, 50 + 3 * (i % 4), close=50 + i % 3) for i in range(60)]
    bars += [bar("SIXDAYS", 6 * i, 60 + 4 * (i % 3), close=60 + 2 * (i % 4)) for i in range(150)]
    bars += [bar("ENDS", i, 40 + 3 * (i % 5), close=40 + 2 * (i % 3)) for i in range(610)]
    bars += [("MONTHLY", None, 50.0, 50.0, 50.0, 50.0, 5)]
    return bars


@pytest.mark.parametrize("start,end", [("2021-08-20", "2021-09-10"), ("2021-06-01", None), (None, "2020-07-15"), ("2021-09-02", "2021-09-02")])
@pytest.mark.parametrize("strict", [False, True])
def test_dates_limit_the_bars_and_not_the_results(spark, start, end, strict):
    bars = frame(spark, sparse_bars(7))
    settings = dict(sma_330=indicators.SMA_330_STRICT) if strict else {}
    whole = [r for r in gap_outcomes(bars, "both", **settings).collect()
             if (not start or str(r.date) >= start) and (not end or str(r.date) <= end)]
    part = gap_outcomes(bars, "both", start, end, **settings).collect()
    assert sorted(map(tuple, part), key=repr) == sorted(map(tuple, whole), key=repr) and whole


def test_few_bars_are_left_around_dates(spark):
    bars = frame(spark, [bar("A", i, 50) for i in range(3000)])
    kept = around_dates(bars, "2026-01-05", "2026-01-20", 365, 330, 10)
    assert kept.count() == 365 + 20 + 330 + 10


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_reads_bars_once_and_limits_before_the_shuffle(spark, tmp_path):
    frame(spark, random_bars(8)).write.parquet(str(tmp_path / "bars"))
    bars = spark.read.parquet(str(tmp_path / "bars"))
    plan = executed(gap_outcomes(bars, "up")).split("Initial Plan")[0]
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("EqualTo(symbol,SPY)" in s for s in scans) == 1
    month = gap_outcomes(bars, "up", "2020-06-01", "2020-06-30")
    text = month._jdf.queryExecution().sparkPlan().toString()
    assert text.count("dense_rank(date") >= 4 and "WindowGroupLimit" in text
    explained = executed(month).split("Initial Plan")[0]
    inner = [i for i, line in enumerate(explained.splitlines()) if "WindowGroupLimit" in line and "Partial" in line]
    assert inner and "GreaterThanOrEqual(date" in explained


def test_money_sums_are_exact_at_real_volumes(spark):
    from fractions import Fraction

    rng = random.Random(3)
    bars = [bar("A", i, 500 + rng.randint(0, 9999) / 100, volume=rng.randint(1, 10**9)) for i in range(3000)]
    tpv = sum(Fraction(round((h + l + c) * 10**6)) * v for _, _, _, h, l, c, v in bars)
    volume = sum(b[6] for b in bars)
    want = float(tpv) / (float(volume) * 3_000_000.0)
    for _ in range(3):
        rng.shuffle(bars)
        table = frame(spark, bars).repartition(7)
        assert gaps.vwap_by_symbol(table).first().vwap == want
    quarterly = [sorted(map(tuple, indicators.with_anchored_vwap_distances(frame(spark, b)).collect()), key=repr) for b in (bars, bars[::-1])]
    assert quarterly[0] == quarterly[1]


def test_whole_units_become_decimals_without_their_text(spark):
    """Typical prices count as before, also beyond what doubles hold exactly, and their way over BIGINT is the one that is taken."""
    odd = [0.0, -0.0, 1e-7, 0.015, 33.333333, -12.5, 1234567.891, 2.9e9, 3.0e9, 3.1e9, 8.99e9, 9.1e9, 1.2345678901e10, 9.9e11, 1e12, 3e13, 1e300, -2e12, float("inf"), -float("inf"), float("nan"), None]
    table = spark.createDataFrame([(i, v, 0.0, 0.000001) for i, v in enumerate(odd * 2)], "i int, high double, low double, close double")
    was = f"try_cast({prices.price_units('high + low + close')} as decimal(18,0))"
    rows = table.selectExpr("high", f"{prices._TYPICAL} as now", f"{was} as was", f"typeof({prices._TYPICAL}) as kind").collect()
    assert all(r.now == r.was and r.kind == "decimal(18,0)" for r in rows), rows
    assert sum(r.now is not None for r in rows) >= 28 and sum(r.now is None for r in rows) >= 8
    assert "as bigint" in prices._TYPICAL
