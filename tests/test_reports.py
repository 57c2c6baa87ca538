import datetime as dt
import math

import pytest

from gapscan.functions.buckets import BENCHMARK_CHANGE, GAP_SIZE, GAP_WIDE, SMA_DISTANCE, Buckets
from gapscan.plans import reports
from gapscan.plans.outcomes import gap_outcomes
from gapscan.schema import LEGACY_NAMES, OUTCOME_COLUMNS
from gapscan.sources.outcome_files import direction_of, normalize_outcomes, publish, read_outcomes, write_outcomes

from helpers import day, frame, random_bars, rows_by

SCHEMA = ", ".join(f"{n} {k}" for n, k in OUTCOME_COLUMNS.items()) + ", direction string"
DEFAULTS = dict(ticker="A", date=day(0), gap_up_percent=2.5, open_price=100.0, anchored_vwap=96.0, direction="short",
                retraced_to_vwap_5d=True, retraced_to_vwap_10d=True, retrace_percentage_5d=150.0,
                retrace_percentage_10d=150.0, gap_filled_5d=True, gap_filled_10d=True,
                retraced_to_21ema_5d=False, retraced_to_21ema_10d=True)


def outcomes(spark, *rows):
    names = [*OUTCOME_COLUMNS, "direction"]
    return spark.createDataFrame([tuple((DEFAULTS | r).get(n) for n in names) for r in rows], SCHEMA)


def test_buckets_are_half_open(spark):
    buckets = Buckets([0, 1, 2.5], ["a", "b"])
    from pyspark.sql import functions as F

    values = spark.createDataFrame([(v,) for v in (-0.1, 0.0, 0.99, 1.0, 2.49, 2.5, None)], "v double")
    numbers = [r[0] for r in values.select(buckets.ordinal(F.col("v"))).collect()]
    assert numbers == [None, 0, 0, 1, 1, None, None]
    with pytest.raises(ValueError):
        Buckets([0, 1], ["a", "b"])


def test_performance_conventions(spark):
    table = outcomes(
        spark, {}, {},
        {"gap_up_percent": 3.0, "retraced_to_vwap_5d": None, "retrace_percentage_5d": 25.0, "gap_filled_5d": False},
        {"gap_up_percent": 3.99, "retrace_percentage_5d": None},
        {"gap_up_percent": 100.0}, {"date": None, "gap_up_percent": 1.0},
    )
    found = rows_by(reports.performance_by_gap_size(table, 5), "bucket")
    assert [found[b].trades for b in GAP_SIZE.labels] == [2, 2] + [0] * 10
    all_won = found["2-3%"]
    assert (all_won.avwap_rate, all_won.avwap_pf, all_won.gap_close_pf) == (100.0, math.inf, math.inf)
    assert (all_won.ema21_rate, all_won.ema21_pf) == (0.0, 0.0)
    mixed = found["3-4%"]
    assert (mixed.avwap_rate, mixed.avwap_pf, mixed.gap_close_pf) == (50.0, 0.14, 1.0)
    empty = found["20%+"]
    assert empty.avwap_rate is None and empty.avwap_pf is None and empty.ema21_pf is None
    (year,) = reports.performance_by_year(table, 10).collect()
    assert (year.year, year.trades, year.ema21_pf) == (2020, 5, math.inf)
    (overall,) = reports.profit_factor_overall(table.where("gap_up_percent < 3 and gap_up_percent > 2")).collect()
    assert overall.profit_factor_5d == math.inf
    (overall,) = reports.profit_factor_overall(table.where("false")).collect()
    assert overall.profit_factor_5d == 0.0


def test_win_tables(spark):
    table = outcomes(
        spark,
        {"spy_daily_gain_percent": -5.0, "sma_330_distance_percent": -1000.0},
        {"spy_daily_gain_percent": -5.01, "sma_330_distance_percent": 0.0, "retraced_to_vwap_5d": False},
        {"spy_daily_gain_percent": 5.0, "sma_330_distance_percent": 999.0},
        {"spy_daily_gain_percent": 4.99, "retraced_to_vwap_5d": None},
    )
    by_change = rows_by(reports.win_by_benchmark(table, 5), "bucket")
    assert list(by_change) == BENCHMARK_CHANGE.labels
    assert (by_change["<-3"].rate, by_change[">3"].rate, by_change["0–0.5"].rate) == (100.0, 0.0, None)
    by_distance = rows_by(reports.win_by_sma330(table, 5), "bucket")
    assert (by_distance["<=-20"].rate, by_distance["0–1"].rate, by_distance[">=20"].rate) == (100.0, 0.0, 100.0)
    sides = rows_by(reports.win_above_below_330(table), "side", "horizon")
    assert sides["Above", "5d"].rate == 50.0 and sides["Below", "10d"].rate == 100.0
    assert reports.win_above_below(table).count() == 0
    by_gap = rows_by(reports.retrace_by_gap_bucket(table), "bucket")
    assert by_gap["2–3"].total == 4 and by_gap["50–100"].total == 0 and list(by_gap) == GAP_WIDE.labels


def test_room_follows_direction(spark):
    table = outcomes(spark, {}, {"direction": "LONG"}, {"direction": "Long", "anchored_vwap": 104.0},
                     {"anchored_vwap": None})
    found = rows_by(reports.win_by_avwap_distance(table, 5), "bucket")
    # 4 % room short, 4 % room long, and a long trade already past its level, floored at 0.
    assert {b: r.rate for b, r in found.items() if r.rate is not None} == {"0–1": 100.0, "3–5": 100.0}


def test_pnl_is_capped_and_keeps_unknown(spark):
    table = outcomes(spark, {}, {"ticker": "B", "retrace_percentage_5d": 0.0, "anchored_vwap": 50.0},
                     {"ticker": "C", "anchored_vwap": 50.0}, {"ticker": "D", "retrace_percentage_5d": None},
                     {"ticker": "E", "open_price": 0.0})
    found = rows_by(reports.trade_pnl(table), "ticker")
    assert [found[t].pnl_5 for t in "ABCDE"] == [400.0, -600.0, 1200.0, None, 0.0]
    (total,) = reports.pnl_totals(table).collect()
    assert total.total_pnl_5d == 1000.0


def test_equity_curve_runs_over_all_trades(spark):
    rows = [{"ticker": f"T{i}", "date": day(i % 3), "retrace_percentage_5d": float(i), "retrace_percentage_10d": None}
            for i in range(40)] + [{"ticker": "late", "date": None, "retrace_percentage_10d": None}]
    curve = reports.equity_curve(outcomes(spark, *rows)).collect()
    assert {r.horizon for r in curve} == {"5d"} and len(curve) == 41
    (total,) = reports.pnl_totals(outcomes(spark, *rows)).collect()
    last = [r for r in curve if r.date is None]
    assert math.isclose(last[0].equity, total.total_pnl_5d)
    ends = {d: [r.equity for r in curve if r.date == d] for d in (day(0), day(1), day(2))}
    pnl = {r.ticker: r.pnl_5 for r in reports.trade_pnl(outcomes(spark, *rows)).collect()}
    first = sum(pnl[f"T{i}"] for i in range(0, 40, 3))
    assert any(math.isclose(e, first) for e in ends[day(0)])


def test_monthly_windows_count_months_present(spark):
    rows = [{"date": dt.date(2020, m, 3), "retraced_to_vwap_5d": m % 2 == 0} for m in (1, 2, 4, 8, 9, 11, 12)]
    monthly = reports.monthly_sma5(outcomes(spark, *rows, {"date": dt.date(2020, 1, 9), "ticker": None, "retraced_to_vwap_5d": False})).collect()
    assert [r.total for r in monthly] == [1] * 7 and [r.rate5 for r in monthly][:3] == [0.0, 100.0, 100.0]
    assert math.isclose(monthly[-1].sma5, (100 + 100 + 0 + 0 + 100) / 5)
    win = reports.monthly_win(outcomes(spark, *rows), 10).collect()
    assert all(r.rate == r.ma14 == 100.0 for r in win)
    assert reports.monthly_win_both(outcomes(spark, *rows)).count() == 14


def test_distributions(spark):
    table = outcomes(spark, *[{"gap_up_percent": 2.0 + i / 10, "days_to_retrace_5d": 1 + i % 2} for i in range(41)],
                     {"days_to_retrace_5d": None}, {"retraced_to_vwap_5d": False, "days_to_retrace_5d": 3})
    bins = reports.gap_histogram(table).collect()
    assert len(bins) == 40 and sum(r["count"] for r in bins) == 43 and bins[-1].bin_high == 6.0
    (box,) = reports.gap_box(table).collect()
    assert (box.lowest, box.highest) == (2.0, 6.0)
    days = {r.day: (r["count"], r.percentage) for r in reports.days_to_retrace(table, 5).collect()}
    assert days == {1: (21, 21 / 41 * 100), 2: (20, 20 / 41 * 100)}
    single = reports.gap_histogram(outcomes(spark, {}, {})).collect()
    assert [r["count"] for r in single][:2] == [2, 0]


def test_top_and_trend(spark):
    rows = [{"ticker": f"T{i:02}", "date": day(i), "mfe_percent_10d": float(i) if i else None,
             "spy_daily_gain_percent": i / 10, "retraced_to_vwap_10d": i % 2 == 0} for i in range(25)]
    top = reports.top_mfe(outcomes(spark, *rows)).collect()
    assert [r.ticker for r in top][:2] == ["T24", "T23"] and len(top) == 20
    assert reports.top_mfe(outcomes(spark, *rows), 25).collect()[-1].ticker == "T00"
    assert reports.benchmark_vs_retrace(outcomes(spark, *rows)).count() == 25
    (trend,) = reports.benchmark_trend(outcomes(spark, *rows)).collect()
    assert trend.slope == 0.0 and trend.r2 == 0.0


def test_all_reports_on_empty_and_real_outcomes(spark):
    real = publish(gap_outcomes(frame(spark, random_bars(9)), "up")).persist()
    for name, report in reports.REPORTS.items():
        assert report(real).columns == report(real.where("false")).columns
        report(real.where("false")).collect()
    real.unpersist()


def test_csv_round_trip(spark, tmp_path):
    table = gap_outcomes(frame(spark, random_bars(10)), "down")
    path = str(tmp_path / "output-long")
    write_outcomes(table, path)
    text = [line for f in (tmp_path / "output-long").glob("*.csv") for line in f.read_text().splitlines()]
    assert text[0] == ",".join(OUTCOME_COLUMNS) and ",True," in "".join(text)
    back = read_outcomes(spark, path)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, publish(table).collect()), key=repr)
    assert {r.direction for r in back.collect()} == {"long"}


def test_reading_old_and_broken_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert read_outcomes(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "header.csv").write_text("ticker,date\n")
    assert read_outcomes(spark, str(tmp_path / "header.csv")).count() == 0
    (tmp_path / "old-short.csv").write_text(
        "ticker,date,gap_up_percent,retraced_to_vwap,retrace_percentage,mfe_percent,days_to_retrace_5d\n"
        "A,2020-01-02,3.5,True,50.0,7.25,3.0\nB,not a date,x,False,NaN,,\n"
    )
    a, b = read_outcomes(spark, str(tmp_path / "old-short.csv")).orderBy("ticker").collect()
    assert (a.date, a.gap_up_percent, a.retraced_to_vwap_10d, a.retrace_percentage_10d) == (dt.date(2020, 1, 2), 3.5, True, 50.0)
    assert (a.mfe_percent_10d, a.days_to_retrace_5d, a.retraced_to_vwap_5d, a.direction) == (7.25, 3, None, "short")
    assert (b.date, b.gap_up_percent, b.retraced_to_vwap_10d, b.retrace_percentage_10d) == (None, None, False, None)
    assert [direction_of(p) for p in ("x/output-LONG.csv", "short.csv", "other.csv", "/lake/longrun/output-short", "/short/a/output-long/", "/longs/x")] == [
        "long", "short", "unknown", "short", "long", "unknown"
    ]


def test_current_name_wins_over_old_one(spark):
    table = spark.createDataFrame([(None, 5.0, "Short")], "mfe_percent_10d double, mfe_percent double, direction string")
    (row,) = normalize_outcomes(table, direction="long").collect()
    assert row.mfe_percent_10d is None and row.direction == "short"
    assert set(LEGACY_NAMES) <= set(OUTCOME_COLUMNS) and len(OUTCOME_COLUMNS) == 39


def test_publish_rounds_half_up(spark):
    (row,) = publish(outcomes(spark, {"gap_up_percent": 2.675, "ema_21": None, "open_price": -1.005})).collect()
    assert (row.gap_up_percent, row.ema_21, row.open_price) == (2.68, None, -1.01)
    assert SMA_DISTANCE.edges[0] == -1000
