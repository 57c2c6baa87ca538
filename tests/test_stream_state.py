"""Streams whose results must equal the batch operators, whatever the order of arrival."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gapscan.operators.snapshots import latest_snapshots
from gapscan.sources.bars import bars, dedupe_bars
from gapscan.streaming.bars import Corrections, best_bars, dedupe_stream
from gapscan.streaming.retention import Retention, retain_snapshots

from helpers import BAR_SCHEMA, day, frame, random_bars

ROWS = StructType([StructField("id", LongType()), StructField("text", StringType())])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def land(spark, folder, name, rows, schema=ROWS, at=None):
    """One parquet file in a folder of the source, as of a time."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")
    if at is not None:
        for file in os.listdir(f"{folder}/{name}"):
            os.utime(f"{folder}/{name}/{file}", (at, at))


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_newest_snapshots_stay_as_they_land(spark, tmp_path):
    """Ordered, late, repeated and older snapshots, several files of one snapshot, restarts after each."""
    source, target, checkpoint = (str(tmp_path / name) for name in ("source", "target", "checkpoint"))
    os.mkdir(source)
    retention, landed = Retention(target, 3), []
    assert retention.rows(spark, ROWS).count() == 0
    times = [100, 200, 300, 300, 400, 250, 350, 50, 400, 500, 200, 350]
    for k, at in enumerate(times):
        rows = [(10 * k + i, f"s{at}") for i in range(1 + k % 3)]
        land(spark, source, f"f{k}", rows, at=1_600_000_000 + at)
        landed += [(*r, dt.datetime.fromtimestamp(1_600_000_000 + at, dt.timezone.utc).replace(tzinfo=None)) for r in rows]
        if k % 2:
            run(retain_snapshots(spark, f"{source}/*", target, ROWS, checkpoint, 3, every=None, max_files=1))
            # what has gone does not come back, so files that land after it was dropped make no difference to the newest three
            batch = latest_snapshots(spark.createDataFrame(landed, "id bigint, text string, snapshot_time timestamp"), "snapshot_time", 3)
            newest = sorted({t for *_, t in landed})[-3:]
            got = rows_of(retention.rows(spark, ROWS))
            assert {r[2] for r in got} == set(newest) and got == rows_of(batch.select("id", "text", "snapshot_time"))
    assert len([d for d in os.listdir(target) if d.startswith("snapshot_time=")]) == 3


def test_a_snapshot_column_and_a_batch_that_is_run_again(spark, tmp_path):
    target = str(tmp_path / "target")
    retention = Retention(target, 2)
    batch = lambda rows: spark.createDataFrame(rows, "id bigint, text string, snapshot_time timestamp")
    at = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)
    retention(batch([(1, "a", at(1)), (2, "b", at(2)), (9, "none", None)]), 0)
    for _ in range(2):
        retention(batch([(3, "c", at(2)), (4, "d", at(3)), (5, "e", at(0))]), 1)
    assert [r[0] for r in rows_of(retention.rows(spark, ROWS))] == [2, 3, 4]
    retention(batch([]), 2)
    assert retention.rows(spark, ROWS).count() == 3
    with pytest.raises(ValueError):
        Retention(target, 0)


def streamed(spark, folder, schema=BAR_SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_stream_of_bars_equals_the_batch(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / name) for name in ("source", "target", "checkpoint"))
    rows = random_bars(3, symbols=("A", "B"), days=40)
    rows += [(*r[:2], *[None if random.Random(i).random() < 0.3 else x for x in r[2:6]], r[6]) for i, r in enumerate(rows[::5])]
    random.Random(5).shuffle(rows)
    os.mkdir(source)
    for k in range(6):
        land(spark, source, f"f{k}", rows[k::6], BAR_SCHEMA)
        if k in (2, 3, 5):  # restarts in between
            run(dedupe_stream(streamed(spark, source), target, checkpoint, "60 days", every=None))
            seen = [r for j in range(k + 1) for r in rows[j::6]]
            wanted = rows_of(dedupe_bars(bars(frame(spark, seen))))
            assert rows_of(Corrections(target).bars(spark)) == wanted
    compacted = Corrections(target).compact(spark, str(tmp_path / "compacted"))
    assert rows_of(compacted.bars(spark)) == wanted


def test_state_goes_behind_the_watermark(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / name) for name in ("source", "target", "checkpoint"))
    os.mkdir(source)
    for k in range(8):  # ten days a file
        land(spark, source, f"f{k}", [("A", day(10 * k + i), 1.0, 2.0, 1.0, 1.0 + i, 5) for i in range(10)], BAR_SCHEMA, at=1_600_000_000 + k)
    query = dedupe_stream(streamed(spark, source), target, checkpoint, "5 days", every=None)
    run(query)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states and max(states) <= 20 and states[-1] <= 6
    assert Corrections(target).bars(spark).count() == 80
    # far too late: ignored, while a late one within the delay corrects
    land(spark, source, "late", [("A", day(3), 9.0, 9.0, 9.0, 9.0, 99), ("A", day(76), 8.0, 8.0, 8.0, 8.0, 99), ("A", None, 1.0, 1.0, 1.0, 1.0, 1)], BAR_SCHEMA, at=1_600_000_100)
    run(dedupe_stream(streamed(spark, source), target, checkpoint, "5 days", every=None))
    now = {r.date: r.volume for r in Corrections(target).bars(spark).collect()}
    assert now[day(3)] == 5 and now[day(76)] == 99 and len(now) == 80


def test_best_bars_keep_one_row_of_state_per_bar_and_combine_first(spark, tmp_path):
    os.mkdir(str(tmp_path / "s"))
    land(spark, str(tmp_path / "s"), "f", [("A", day(1), 1.0, 1.0, 1.0, 1.0, None)], BAR_SCHEMA)
    out = best_bars(streamed(spark, str(tmp_path / "s")))
    assert out.isStreaming and out.columns == ["symbol", "date", "open", "high", "low", "close", "volume"]
    assert dict(out.dtypes)["volume"] == "bigint" and out.select(F.col("date")).dtypes == [("date", "date")]
