"""Lookups by time against plain scans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gapscan.catalog import queries as catalog
from gapscan.operators import lookups
from gapscan.sources.bars import bars as typed_bars
from gapscan.sources.bars import dedupe_bars

from helpers import bar, close, day, frame, random_bars, rows_by


def at(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(hours=n)


def tables(seed=1, n=400):
    rng = random.Random(seed)
    keys = ["hot"] * 8 + ["a", "b", "only left", None]
    left = [(i, rng.choice(keys), None if rng.random() < 0.05 else at(rng.randrange(6000))) for i in range(n)]
    right = [(rng.choice(keys[:-2] + [None, "only right"]), None if rng.random() < 0.05 else at(rng.randrange(6000) // 7 * 7), rng.randrange(5), rng.choice((None, 1.5, 2.5))) for _ in range(n)]
    return left, right


def plain(left, right, strict):
    out = {}
    for i, key, t in left:
        fits = [r for r in right if key is not None and t is not None and r[0] == key and r[1] is not None and (r[1] < t if strict else r[1] <= t)]
        best = max(fits, key=lambda r: (r[1], r[2], r[3] is not None, r[3] or 0), default=None)
        out[i] = (None, None) if best is None else (best[2], best[3])
    return out


@pytest.mark.parametrize("strict", [True, False])
def test_asof_join_equals_a_scan(spark, strict):
    left, right = tables()
    lefts = spark.createDataFrame(left, "id int, symbol string, at timestamp").repartition(5)
    rights = spark.createDataFrame(right, "symbol string, seen timestamp, no int, price double").repartition(5)
    for piece in (lookups.by_quarter, lambda t: F.date_trunc("day", t), lambda t: F.lit(1)):
        found = lookups.asof_join(lefts, rights, "symbol", "at", "seen", {"no": "last_no", "price": "last_price"}, strict=strict, ties=["no"], piece=piece)
        assert found.columns == ["id", "symbol", "at", "last_no", "last_price"]
        assert {r.id: (r.last_no, r.last_price) for r in found.collect()} == plain(left, right, strict)


def test_asof_join_without_rows(spark):
    left, right = tables()
    lefts = spark.createDataFrame(left, "id int, symbol string, at timestamp")
    rights = spark.createDataFrame(right, "symbol string, seen timestamp, no int, price double")
    join = lambda a, b: lookups.asof_join(a, b, "symbol", "at", "seen", {"no": "last_no"}).collect()
    assert join(lefts.limit(0), rights) == [] and len(join(lefts, rights.limit(0))) == len(left)
    with pytest.raises(ValueError):
        lookups.asof_join(lefts, rights, "symbol", "at", "seen", {"no": "id"})


def test_a_key_with_most_rows_is_spread_and_rows_meet_no_pairs(spark):
    left = spark.range(20_000).selectExpr("id", "'hot' as symbol", "timestamp_seconds(id * 3600) as at")
    right = spark.range(20_000).selectExpr("'hot' as symbol", "timestamp_seconds(id * 3600 + 60) as seen", "id as no")
    found = lookups.asof_join(left, right, "symbol", "at", "seen", {"no": "last_no"})
    assert found.where("last_no = id - 1").count() == 19_999
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect" not in plan.replace("collectlimit", "")


def test_vwap_since_an_anchor_of_each_row(spark):
    bars = random_bars(6, symbols=("A", "B"), days=200)
    unique = dedupe_bars(typed_bars(frame(spark, bars))).persist()
    history = {}
    for r in unique.orderBy("date").collect():
        history.setdefault(r.symbol, []).append(r)
    rng = random.Random(3)
    asked = [(i, rng.choice("AABC"), day(rng.randrange(-5, 210)), None if i % 11 == 0 else day(rng.randrange(-20, 205))) for i in range(300)]
    asked += [(1000, "A", None, day(3)), (1001, None, day(30), day(3))]
    found = lookups.avwap_since(spark.createDataFrame(asked, "id int, symbol string, date date, anchor date"), unique, "anchor", name="vwap")
    got = rows_by(found, "id")
    assert found.columns == ["id", "symbol", "date", "anchor", "vwap"] and len(got) == len(asked)
    for i, symbol, date, anchor in asked:
        part = [r for r in history.get(symbol, []) if date is not None and r.date <= date and (anchor is None or r.date >= anchor)]
        typical = [(r.high + r.low + r.close) / 3 for r in part]
        volume = sum(r.volume for r in part)
        wanted = None if not part else sum(t * r.volume for t, r in zip(typical, part)) / volume if volume else sum(typical) / len(typical)
        assert (got[i].vwap is None) == (wanted is None) and (wanted is None or close(got[i].vwap, wanted)), (i, got[i], wanted)
    unique.unpersist()


def test_vwaps_since_anchors_take_one_pass_over_the_bars(spark):
    bars = frame(spark, [bar("A", n, 50 + n, volume=10 + n) for n in (0, 1, 3, 8)])
    rows = spark.createDataFrame([("A", day(3), day(1)), ("A", day(5), day(2)), ("A", day(9), None), ("B", day(3), day(1))], "symbol string, date date, anchor date")
    found = lookups.avwap_since(rows, bars, "anchor")
    # one window gives both lookups their sums, and is planned once for each; there were eight
    assert found._jdf.queryExecution().executedPlan().toString().count("Window [") <= 2
    exact = lambda *days: sum((50 + n) * (10 + n) for n in days) / sum(10 + n for n in days)
    got = {(r.symbol, r.date): r.anchored_vwap for r in found.collect()}
    assert got.pop(("B", day(3))) is None
    assert got == pytest.approx({("A", day(3)): exact(1, 3), ("A", day(5)): exact(3), ("A", day(9)): exact(0, 1, 3, 8)})


def test_anchors_with_a_time_of_day(spark):
    bars = frame(spark, [bar("A", n, 50 + n, volume=10) for n in (0, 1, 2)])
    rows = spark.createDataFrame([("A", day(2), day(1))], "symbol string, date date, anchor date")
    noon = rows.selectExpr("symbol", "date", "cast(anchor as timestamp) + interval 12 hours as anchor")
    assert lookups.avwap_since(rows, bars, "anchor").first().anchored_vwap == pytest.approx(51.5)
    assert lookups.avwap_since(noon, bars, "anchor").first().anchored_vwap == pytest.approx(52)


def shuffles(found):
    """Shuffles that are written, and joins, of the plan."""
    plan = found._jdf.queryExecution().executedPlan().toString()
    return plan.replace("ReusedExchange", "").count("- Exchange "), plan.count("Join")


@pytest.fixture
def planned_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_lookups_after_one_another_write_bars_and_rows_once(spark, planned_once):
    bars = frame(spark, [bar("A", n, 50 + n, volume=10 + n) for n in (0, 1, 3, 8)] + [bar(None, 1, 7)])
    asked = [("A", day(3), 53.0, day(1)), ("A", day(3), 53.0, day(1)), ("A", day(9), 60.0, None), ("A", None, 1.0, day(1)), ("B", day(3), 1.0, day(1)), (None, day(3), 1.0, day(1))]
    rows = spark.createDataFrame(asked, "symbol string, date date, close double, anchor date")
    found = lookups.with_distance_since(lookups.avwap_since(rows, bars, "anchor"), bars, "anchor")
    # there were 12 shuffles and 6 joins
    assert shuffles(found) == (2, 0)
    assert found.columns == [*rows.columns, "anchored_vwap", "avwap_distance_percent"]
    exact = lambda *days: sum((50 + n) * (10 + n) for n in days) / sum(10 + n for n in days)
    wanted = [exact(1, 3), exact(1, 3), exact(0, 1, 3, 8), None, None, None]
    key = lambda r: tuple((x is None, x) for x in r[:4])
    got = sorted((tuple(r) for r in found.collect()), key=key)
    assert [r[:4] for r in got] == sorted(asked, key=key)
    for r, v in zip(got, [w for _, w in sorted(zip(asked, wanted), key=lambda x: key(x[0]))]):
        assert r[4] == pytest.approx(v) and r[5] == pytest.approx(v and (r[2] - v) / v * 100), r


def test_avwap_since_of_the_catalog_writes_each_shuffle_once(spark, planned_once, tmp_path):
    lines = spark.range(60).selectExpr("id % 4 as l_suppkey", "cast(date_add(date '1995-01-01', cast(id * 7 % 90 as int)) as timestamp_ntz) as l_shipdate", "1000D + id * 13 as l_extendedprice", "1D + id % 9 as l_quantity")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.QUERIES["avwap_since"](spark, str(tmp_path))
    # days of the benchmark, raw bars to be told apart, and the bars as such and as rows that ask; there were 8 and 6 joins
    assert shuffles(found) == (4, 0)
    assert found.where("anchored_vwap is null").count() == 0 and found.count() == catalog.unique(spark, str(tmp_path)).count()


def test_avwap_since_without_rows_or_bars(spark):
    bars = frame(spark, [bar("A", n, 50 + n) for n in range(3)])
    rows = spark.createDataFrame([("A", day(2), day(1)), ("B", day(2), day(1))], "symbol string, date date, anchor date")
    none = frame(spark, [])
    assert lookups.avwap_since(rows.where("symbol > 'C'"), bars, "anchor").collect() == []
    assert [r.anchored_vwap for r in lookups.avwap_since(rows, none, "anchor").collect()] == [None, None]
    twice = lookups.with_distance_since(lookups.avwap_since(rows, none, "anchor").selectExpr("*", "1D as close"), bars, "anchor")
    assert {r.symbol: (r.anchored_vwap, r.avwap_distance_percent is None) for r in twice.collect()} == {"A": (None, False), "B": (None, True)}
