"""Report tables of the one pass against the single reports."""

import pytest
from pyspark.sql import functions as F

from gapscan.catalog import queries as catalog
from gapscan.plans.outcomes import gap_outcomes
from gapscan.plans.report_cube import Cube
from gapscan.plans.reports import REPORTS
from gapscan.sources.bars import bars as typed_bars
from gapscan.sources.outcome_files import publish

from helpers import frame, random_bars

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["old file", "some unknown", "empty"])
def outcomes(spark, request):
    if request.param == "old file":
        table = catalog._old_file(spark, SF_DIR)
    else:
        table = catalog.published(spark, SF_DIR, "down" if request.param == "down" else "up")
    if request.param == "empty":
        table = table.limit(0)
    if request.param == "some unknown":
        unknown = {c: F.when(F.xxhash64("ticker", "date", F.lit(c)) % 5 != 0, F.col(c)) for c in table.columns if c not in ("ticker", "direction")}
        table = table.withColumns(unknown)
    table = table.persist()
    yield table
    table.unpersist()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tables_equal_the_single_reports(spark, outcomes):
    cube = Cube.of(outcomes)
    kept = Cube(cube.sums.coalesce(1).persist(), cube.known)
    tables = kept.reports()
    assert len(tables) == 29
    for name, table in tables.items():
        single = REPORTS[name](outcomes)
        assert dict(table.dtypes) == dict(single.dtypes), name
        assert rows_of(table.select(*single.columns)) == rows_of(single), name
    kept.sums.unpersist()


def test_cubes_of_parts_add_up(spark):
    table = catalog.published(spark, SF_DIR).persist()
    parts = [Cube.of(table.where(F.year("date") % 3 == k)) for k in range(3)]
    merged, whole = parts[0].merged(parts[1:]), Cube.of(table)
    assert rows_of(merged.sums.select(sorted(merged.sums.columns))) == rows_of(whole.sums.select(sorted(whole.sums.columns)))
    table.unpersist()


def test_outcomes_are_scanned_once_and_combined_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "outcomes")
    catalog.published(spark, SF_DIR).write.parquet(path)
    table = spark.read.parquet(path)
    plan = Cube.of(table).sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "partial_sum" in plan


def test_histogram_bounds_and_counts_come_from_one_scan(spark, tmp_path):
    path = str(tmp_path / "outcomes")
    publish(gap_outcomes(typed_bars(frame(spark, random_bars(3))), min_price=5)).write.parquet(path)
    table = spark.read.parquet(path)
    for histogram in (Cube.of(table).reports()["gap_histogram"], REPORTS["gap_histogram"](table)):
        histogram.collect()
        assert "ReusedExchange" in histogram._jdf.queryExecution().executedPlan().toString()
