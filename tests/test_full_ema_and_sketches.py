"""The whole-history EMA against a plain fold, sketches by date against exact results."""

import random

import pytest
from pyspark.sql import functions as F

from gapscan.catalog import queries as catalog
from gapscan.operators import indicators
from gapscan.plans import reports, sketches
from gapscan.sources.bars import bars as typed_bars
from gapscan.sources.bars import dedupe_bars

from helpers import bar, day, frame, random_bars


def folded(path, span, min_bars):
    y, out = None, []
    for n, close in enumerate(path, 1):
        if close is not None:
            y = close if y is None else y * (1 - 2 / (span + 1)) + close * 2 / (span + 1)
        out.append(y if n >= min_bars else None)
    return out


@pytest.mark.parametrize("span, min_bars", [(21, 21), (5, 1), (200, 3)])
def test_full_ema_equals_a_fold(spark, span, min_bars):
    rng = random.Random(2)
    rows = [r if rng.random() > 0.1 else (*r[:5], None, r[6]) for r in random_bars(5, symbols=("A", "B"), days=700)]
    rows += [("C", day(n), 1.0, 1.0, 1.0, None if n < 100 or n % 3 else 50.0 + n, 1) for n in range(0, 400, 7)] + [("D", day(3), 1.0, 1.0, 1.0, None, 1), bar("E", 3, 9.0)]
    rows += [("A", None, 1.0, 1.0, 1.0, 1.0, 1)]
    unique = dedupe_bars(typed_bars(frame(spark, rows))).persist()
    history = {}
    for r in unique.where("date is not null").orderBy("date").collect():
        history.setdefault(r.symbol, []).append(r)
    found = {(r.symbol, r.date): r.ema for r in indicators.full_ema(unique, span, min_bars).collect()}
    wanted = {(s, r.date): y for s, path in history.items() for r, y in zip(path, folded([r.close for r in path], span, min_bars))}
    assert found.keys() == wanted.keys()
    for key, y in wanted.items():
        assert (found[key] is None) == (y is None) and (y is None or abs(found[key] - y) < 1e-9 * max(1, abs(y))), key
    unique.unpersist()
    with pytest.raises(ValueError):
        indicators.full_ema(unique, 3)


def test_one_symbol_is_spread_over_its_quarters(spark):
    rows = frame(spark, [bar("A", n, 50 + n % 17) for n in range(3000)])
    plan = indicators.full_ema(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and plan.count("Window") == plan.count("Window [") and "_quarter" in plan


@pytest.fixture(scope="module")
def table(spark):
    outcomes = catalog.published(spark, "/root/testdata/sf0.01").persist()
    yield outcomes
    outcomes.unpersist()


def test_merged_dates_are_near_the_exact_results(spark, table, tmp_path):
    path = str(tmp_path / "sketches")
    sketches.daily_sketches(table).write.parquet(path)
    stored = spark.read.parquet(path)
    for start, end in ((None, None), ("1995-01-01", "1996-12-31"), ("1995-02-01", "1995-06-30")):
        part, days = sketches.in_range(table, start, end).persist(), sketches.in_range(stored, start, end)
        exact, near = reports.header(part).first(), sketches.header(days).first()
        assert near[:3] == exact[:]
        tickers = part.agg(F.count_distinct("ticker")).first()[0]
        assert abs(near.ticker_count - tickers) <= max(2, 0.05 * tickers)
        lowest, highest = part.agg(F.min("gap_up_percent"), F.max("gap_up_percent")).first()
        box, values, n = sketches.box(days).first(), sorted(r[0] for r in part.select("gap_up_percent").collect()), exact.row_count
        assert (box.lowest, box.highest) == (lowest, highest)
        for name, q in sketches.QUANTILES.items():
            low, high = (sum(v < box[name] for v in values) / n, sum(v <= box[name] for v in values) / n)
            assert low - 0.03 <= q <= high + 0.03, (name, low, high)
        share = sketches.share_up_to(days, "gap_up_percent", 4.0).first()[0]
        assert abs(share - sum(v <= 4.0 for v in values) / n) < 0.03
        part.unpersist()


def test_sketches_of_groups_of_unknown_values_and_of_nothing(spark, table):
    by_year = sketches.merged(sketches.daily_sketches(table).withColumn("year", F.year("date")), ["year"])
    assert {r.year: r.n for r in by_year.collect()} == {r[0]: r[1] for r in table.groupBy(F.year("date")).count().collect()}
    unknown = table.limit(50).withColumn("gap_up_percent", F.lit(None).cast("double")).withColumn("date", F.lit(None).cast("date"))
    daily = sketches.daily_sketches(unknown)
    assert daily.count() == 1 and sketches.box(daily).first()[:] == (None,) * 5 and sketches.header(daily).first().row_count == 50
    empty = sketches.daily_sketches(table.limit(0))
    assert empty.count() == 0 and sketches.header(empty).first()[:] == (0, 0, "unknown", 0)
