"""Outcomes that follow new bars against one run over all of them."""

import datetime as dt
import glob
import os
import random

import pytest

from gapscan.plans.outcomes import gap_outcomes
from gapscan.plans.upkeep import changed_dates, read_table, runs_of, update_outcomes
from gapscan.sources.bars import around_dates
from gapscan.sources.bars import bars as typed_bars

from helpers import day, frame, random_bars


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_appends_and_late_bars_equal_a_full_run(spark, tmp_path):
    """Most bars come date by date; some come late, some are corrected by a copy with more volume, one gap so disappears."""
    path = str(tmp_path / "outcomes")
    rows = random_bars(11, symbols=("A", "B", "C", "SPY"), days=230)
    # C has few bars, so what it looks ahead to lies far away
    rng = random.Random(2)
    rows = [r for r in rows if r[0] != "C" or rng.random() < 0.15]
    late = {i for i, r in enumerate(rows) if rng.random() < 0.02 and r[1] > day(60)}
    first = [r for i, r in enumerate(rows) if r[1] < day(180) and i not in late]
    settings = dict(min_price=5)
    update_outcomes(frame(spark, first), frame(spark, first), path, "both", **settings)
    have = list(first)
    assert rows_of(read_table(spark, path)) == rows_of(gap_outcomes(typed_bars(frame(spark, have)), "both", **settings))
    steps = [[r for i, r in enumerate(rows) if day(180 + 25 * k) <= r[1] < day(205 + 25 * k) and i not in late] for k in range(2)]
    steps.append([rows[i] for i in late])
    gaps = sorted(read_table(spark, path).where("ticker <> 'SPY'").select("ticker", "date").collect())
    ticker, date = gaps[len(gaps) // 2]
    at = next(r for r in first if r[0] == ticker and r[1] == date)
    steps.append([(ticker, date, at[5], at[3], at[4], at[5], 10**6)])  # traded more, and opens where it closes
    for step in steps:
        have += step
        update_outcomes(frame(spark, have), frame(spark, step), path, "both", **settings)
        assert rows_of(read_table(spark, path)) == rows_of(gap_outcomes(typed_bars(frame(spark, have)), "both", **settings))
    assert not glob.glob(f"{path}.staging")


def test_other_dates_are_neither_written_nor_read(spark, tmp_path):
    path = str(tmp_path / "outcomes")
    rows = random_bars(4, symbols=("A", "B", "SPY"), days=900)
    before, new = [r for r in rows if r[1] < day(898)], [r for r in rows if r[1] >= day(898)]
    update_outcomes(frame(spark, before), frame(spark, before), path, min_price=5)
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*/*.parquet")}
    dates = update_outcomes(frame(spark, rows), frame(spark, new), path, min_price=5)
    assert max(dates) >= day(898) and len(dates) < 40 and min(dates) > day(840)
    now = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*/*.parquet")}
    untouched = [f for f in files if dt.date.fromisoformat(f.split("date=")[1][:10]) not in dates]
    assert len(untouched) > 50 and all(files[f] == now[f] for f in untouched)
    # of 900 days about 330 bars before the year before the quarter are looked at, at most
    looked_at = around_dates(typed_bars(frame(spark, rows)), str(min(dates)), str(max(dates)), 365, 1, 10)
    assert looked_at.count() < 0.7 * len(rows)
    assert update_outcomes(frame(spark, rows), frame(spark, []), path) == []


def test_which_dates_change(spark):
    bars = [("A", day(n), 1.0, 1.0, 1.0, 1.0, 1) for n in range(0, 2000, 2)] + [("SPY", day(n), 1.0, 1.0, 1.0, 1.0, 1) for n in (0, 1001, 1005, 1999)]
    table = frame(spark, bars)
    found = lambda *new: [r.date for r in changed_dates(table, frame(spark, [(s, d, *[1.0] * 4, 1) for s, d in new])).collect()]
    # ten bars ahead, and what looks back on a bar in the middle: 330 bars, here more than a year and a quarter
    assert found(("A", day(1998))) == [day(n) for n in range(1978, 2000, 2)]
    assert found(("A", day(1000)))[0] == day(980) and found(("A", day(1000)))[-1] == day(1000 + 2 * 330)
    assert set(found(("SPY", day(1001)))) >= {day(0), day(1001), day(1005)}
    assert found(("B", day(3))) == [] and found(("A", None)) == []
    assert runs_of([day(1), day(2), day(40), day(41), day(200)]) == [[day(1), day(2)], [day(40), day(41)], [day(200)]]
    with pytest.raises(ValueError):
        update_outcomes(table, table, "nowhere", "sideways")


def test_what_a_bar_costs_does_not_depend_on_how_far_it_looks(spark):
    """Running maxima instead of frames that go through hundreds of bars for each bar, and one pass over the bars."""
    rng = random.Random(5)
    bars = [(s, day(n), *[1.0] * 4, 1) for s in ("A", "B", "SPY", None) for n in range(0, 1500, 3) if rng.random() < 0.8] + [("A", None, *[1.0] * 4, 1)]
    new = rng.sample(bars, 4) + [("Z", day(0), *[1.0] * 4, 1)]
    found = changed_dates(frame(spark, bars), frame(spark, new))
    expected = set()
    for symbol in ("A", "B", "SPY"):
        dates = sorted({b[1] for b in bars if b[0] == symbol and b[1]})
        at = [i for i, d in enumerate(dates) if any(b[0] == symbol and b[1] == d for b in new)]
        expected |= {d for i, d in enumerate(dates) if any(i <= j <= i + 10 or 0 <= i - j <= 330 or 0 <= (d - dates[j]).days <= 457 for j in at)}
        expected |= {dates[j + k] for j in at for k in (0, 1) if symbol == "SPY" and j + k < len(dates)}
    assert [r.date for r in found.collect()] == sorted(expected) and 0 < len(expected) < 500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "330" not in "".join(line for line in plan.splitlines() if "Window [" in line) and plan.count("Join") == 0
