import pytest

from gapscan.plans.jobs import analyze, report_from_file
from gapscan.plans.reports import REPORTS
from gapscan.sources.bars import OPEN, read_bars
from gapscan.sources.outcome_files import read_outcomes

from helpers import frame, random_bars


def test_bars_to_report_tables(spark, tmp_path):
    stored = str(tmp_path / "bars")
    frame(spark, random_bars(11)).write.parquet(stored)
    bars = read_bars(spark, stored, format="parquet")
    total = 0
    for mode, direction in (("up", "short"), ("down", "long")):
        summary = analyze(bars, str(tmp_path), mode, "2020-01-01", "2020-12-31").collect()
        assert len({r.date for r in summary}) == len(summary) > 200
        total = sum(r.total_gap_ups for r in summary)
        paths = report_from_file(spark, str(tmp_path / f"output-{direction}"), str(tmp_path / f"report-{direction}"))
        assert paths.keys() == REPORTS.keys()
        (header,) = spark.read.parquet(paths["report_header"]).collect()
        assert (header.row_count, header.direction) == (total, direction) and total > 10


def test_bars_from_table_with_missing_volume(spark):
    frame(spark, [("A", None, 1.0, 1.0, float("nan"), 1.0, None)]).createOrReplaceTempView("some_bars")
    (row,) = read_bars(spark, "some_bars").collect()
    assert (row.volume, row.low, row.close) == (0, None, 1.0)


def test_both_modes_write_a_file_each(spark, tmp_path):
    bars = frame(spark, random_bars(11))
    both = analyze(bars, str(tmp_path), "both", "2020-03-01", OPEN).collect()
    short, long = (read_outcomes(spark, str(tmp_path / f"output-{d}")) for d in ("short", "long"))
    assert {r.direction for r in short.collect()} == {"short"} and {r.direction for r in long.collect()} == {"long"}
    assert sum(r.total_gap_ups for r in both) == short.count() + long.count() > 10
    with pytest.raises(ValueError):
        analyze(bars, str(tmp_path / "x"), "sideways")
