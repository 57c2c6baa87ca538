"""The registered queries: every operator on the test tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscan.operators import forward, gaps, indicators, keyed, lookups, snapshots, text
from gapscan.plans.outcomes import candidate_gaps, gap_outcomes, gap_touches
from gapscan.plans.report_cube import Cube
from gapscan.plans.reports import REPORTS
from gapscan.plans.summaries import summary_by_date, summary_overall
from gapscan.plans.upkeep import read_table, update_outcomes
from gapscan.schema import LEGACY_NAMES, OUTCOME_COLUMNS
from gapscan.sources.bars import OPEN, bars, bars_of, dedupe_bars, trading_dates
from gapscan.sources.lineitem_bars import raw_bars
from gapscan.sources.outcome_files import normalize_outcomes, publish, read_outcomes, write_outcomes

Query = Callable[[SparkSession, str], DataFrame]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(raw_bars(spark, sf_dir))


def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_bars(raw(spark, sf_dir))


def published(spark: SparkSession, sf_dir: str, mode: str = "up") -> DataFrame:
    return publish(gap_outcomes(raw(spark, sf_dir), mode))


def candidates(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return candidate_gaps(unique(spark, sf_dir), mode)


def followed(spark: SparkSession, sf_dir: str, mode: str, *features) -> DataFrame:
    """Gaps with room, with their following bars and further features."""
    described = gaps.add_features(
        unique(spark, sf_dir), [gaps.PREV_CLOSE, gaps.AVWAP_3D, forward.forward_columns(), *features]
    )
    return forward.with_forward_extremes(gaps.avwap_room(gaps.find_gaps(described, mode), mode))


def shared_folder(spark: SparkSession) -> str:
    """A new folder where the cluster keeps checkpoints, or a local one in a test session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="run-gapscan-")
    return os.path.join(base, f"gapscan-{uuid.uuid4().hex}")


def _gaps(mode: str) -> Query:
    return lambda spark, d: gaps.largest_first(
        gaps.find_gaps(gaps.with_prev_close(unique(spark, d)), mode)
    )


def _gaps_room(mode: str) -> Query:
    return lambda spark, d: gaps.largest_first(candidates(spark, d, mode))


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/output-short"
    write_outcomes(gap_outcomes(raw(spark, sf_dir), "up"), path)
    return read_outcomes(spark, path)


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome table as older files have it: old names, text values, columns missing."""
    old = published(spark, sf_dir).drop("direction", "ema_21", "spy_daily_gain_percent")
    renamed = old.withColumnsRenamed(LEGACY_NAMES)
    as_text = renamed.select(*[F.col(c).cast("string").alias(c) for c in renamed.columns])
    return normalize_outcomes(as_text, direction="short")


def _touches(name: str) -> list[str]:
    return [c for c in OUTCOME_COLUMNS if name in c]


def _retrace_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both gap modes, one after the other."""
    parts = [
        forward.with_vwap_touch(followed(spark, sf_dir, mode), mode).select(
            F.lit(mode).alias("mode"), "symbol", "date", "anchored_vwap",
            *[f"{c}_{h}d" for h in (5, 10) for c in ("retraced_to_vwap", "days_to_retrace")],
        )
        for mode in ("up", "down")
    ]
    return parts[0].unionByName(parts[1])


def _retrace_ema21(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = followed(spark, sf_dir, mode, indicators.ema())
        return forward.with_ema_touch(table, mode).select("symbol", "date", "ema_21", *_touches("21ema"))

    return query


def _measured(columns: list[str], add_measures: Callable[[DataFrame], DataFrame], mode: str = "up") -> Query:
    return lambda spark, d: add_measures(followed(spark, d, mode)).select("symbol", "date", *columns)


def _far_touches(days: int | None, bars: int | None) -> Query:
    """First touches of the anchored VWAP of both gap modes' gaps far on."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        described = gaps.add_features(unique(spark, sf_dir), [gaps.PREV_CLOSE, gaps.AVWAP_3D])
        levels = {
            mode: f"if(symbol is not null and date is not null and {gaps.is_gap(mode)} and {gaps.has_room(mode)}, anchored_vwap, null)"
            for mode in ("up", "down")
        }
        return forward.far_touches(described, levels, bars, days)

    return query


def _horizons(*names: str) -> list[str]:
    return [f"{name}_{h}d" for h in (5, 10) for name in names]


def _report(report: Callable[[DataFrame], DataFrame], mode: str = "up") -> Query:
    return lambda spark, d: report(published(spark, d, mode))


#: A range of dates inside the test tables.
MONTH = ("1995-03-01", "1995-03-31")

#: Reports whose measures an old file lacks in part, and those that treat the two directions differently.
OLD_FILE_REPORTS = (
    "overall_rates", "profit_factor_overall", "perf_by_year_5d", "perf_by_year_10d", "monthly_sma5", "monthly_win_5d",
    "monthly_win_10d", "monthly_win_both", "win_by_gap_5d", "win_by_gap_10d", "win_above_below",
)
#: Report tables that are also made from the one pass that serves all of them.
CUBE_REPORTS = (
    "report_header", "perf_by_year_10d", "perf_by_gap_size_5d", "monthly_sma5", "gap_histogram", "win_by_avwap_distance_10d", "win_above_below",
    "days_to_retrace_10d", "benchmark_vs_retrace",
)
LONG_REPORTS = (
    "report_header", "perf_by_year_10d", "perf_by_gap_size_10d", "win_by_avwap_distance_5d", "win_by_avwap_distance_10d", "equity_curve",
)

#: What outcome files had before they had two horizons.
OLD_COLUMNS = ("ticker", "date", "gap_up_percent", "open_price", "close_price", "anchored_vwap")


def _outcomes_upkept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome table that bars are added to in three steps; the second misses bars that come with the third."""
    path, all_bars = f"{shared_folder(spark)}/outcomes", raw(spark, sf_dir)
    late = "(symbol = 'S7' or xxhash64(symbol) % 4 = 0) and date between date '1998-03-01' and date '1998-03-05'"
    steps = ["date < date '1998-02-01'", f"date < date '1998-06-01' and not ({late})", "true"]
    before = "false"
    for step in steps:
        update_outcomes(all_bars.where(step), all_bars.where(f"{step} and not ({before})"), path)
        before = step
    return read_table(spark, path)


def _old_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome file of the oldest kind: one horizon, under its old names."""
    old = published(spark, sf_dir).select(*OLD_COLUMNS, *LEGACY_NAMES).withColumnsRenamed(LEGACY_NAMES)
    return publish(normalize_outcomes(old, direction="short"))


def _report_of_old_file(name: str) -> Query:
    return lambda spark, d: REPORTS[name](_old_file(spark, d))


def _report_of_cube(name: str) -> Query:
    return lambda spark, d: Cube.of(published(spark, d)).reports()[name]


def _busy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with volumes as real markets have them."""
    return unique(spark, sf_dir).withColumn("volume", F.col("volume") * 10_000_000)


def _top_gap_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = gaps.top_gaps_per_date(published(spark, sf_dir), size="gap_up_percent", symbol="ticker")
    return ranked.select("date", "rank", "ticker", "gap_up_percent", *_horizons("retrace_percentage", "mfe_percent", "mae_percent"))


def _dated_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = trading_dates(raw(spark, sf_dir), OPEN, OPEN)
    return summary_by_date(gap_touches(raw(spark, sf_dir), "up"), dates)


def _asof_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event, moved into the bars' years and given a symbol (a third of all the same), with the last close before its day."""
    moved = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "if(event_id % 3 = 0, 'SPY', concat('S', 1 + user_id % 120)) as symbol",
        "cast(date_add(date '1992-01-01', cast(event_id * 37 % 2600 as int)) as timestamp_ntz) + (ts - date_trunc('day', ts)) as at",
    )
    closes = unique(spark, sf_dir).select("symbol", "date", "close")
    return lookups.asof_join(moved, closes, "symbol", "at", "date", {"date": "close_date", "close": "last_close"}, strict=False)


def _avwap_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar's VWAP since an anchor of its own, 0 to 400 days back."""
    bars_ = unique(spark, sf_dir)
    anchored = bars_.selectExpr("symbol", "date", "close", "date_sub(date, (day(date) * 131 + month(date) * 17) % 401) as anchor")
    return lookups.with_distance_since(lookups.avwap_since(anchored, bars_, "anchor"), bars_, "anchor")


def event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their value in steps of 20 and their day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(
        "event_id", "user_id", "event_type", "ts", "cast(floor(value / 20) as bigint) as level", "to_date(ts) as day"
    )


def level_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.changes_only(
        event_levels(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"], "level", F.date_trunc("hour", "ts")
    )


def _distinct_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.distinct_blocks(
        level_changes(spark, sf_dir), ["user_id"], "day", ["ts", "event_id"], "event_type", "level", F.date_trunc("hour", "ts")
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _style_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = text.style_bodies(pages(spark, sf_dir).select("page_id", "html"), "html")
    return text.extract_rules(bodies, "html")


def _strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts with their own comments put into the form the operator removes."""
    commented = pages(spark, sf_dir).selectExpr(
        "page_id", "replace(replace(html, '<!--', '/*'), '-->', '*/') as html"
    )
    return text.strip_comments(commented, "html")


def _strip_comments_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts cut into pieces of 97 characters, and put together afterwards."""
    commented = pages(spark, sf_dir).selectExpr("page_id", "replace(replace(html, '<!--', '/*'), '-->', '*/') as html")
    pieces = commented.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s).{1,97}"), F.lit(0))).alias("no", "html"))
    cleaned = text.strip_comments_in_pieces(pieces, "page_id", "no", "html")
    joined = cleaned.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("no", "html")))["html"], "").alias("html"))
    return joined


def order_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small style sheet per order: one rule per line, at most seven lines each."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "concat(l_returnflag, ' { status: ', l_linestatus, ';\n  discount: ',"
        " cast(cast(round(l_discount * 20) as int) as string), '; }\n') as rule",
    )
    rules = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "rule"))).alias("r"))
    return rules.select("l_orderkey", F.array_join("r.rule", "").alias("sheet"))


def event_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style sheet per user whose events open rules, declare values and close rules, not always in balance."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    piece = F.expr(
        "case when event_id % 6 < 2 then concat('@', event_type, ' { ') when event_id % 6 < 4 then concat(event_type, ': ', event_id, ';\n')"
        " else concat('last: ', event_id % 10, ' }\n') end"
    )
    pieces = events.select("user_id", F.struct("ts", "event_id", piece.alias("piece")).alias("e"))
    return pieces.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("e"))["piece"], "").alias("sheet"))


def _nested_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = text.nested_rules(event_sheets(spark, sf_dir), "user_id", "sheet")
    return rules.withColumn("path", F.array_join("path", " / "))


def _cleaned_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.clean_rules(order_sheets(spark, sf_dir), "l_orderkey", "sheet")


def _latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.latest_snapshots(event_levels(spark, sf_dir), "day", 10)


QUERIES: dict[str, Query] = {
    "candles_raw": raw,
    "candles_dedup": unique,
    "trading_dates": lambda s, d: trading_dates(raw(s, d), OPEN, OPEN),
    "outcomes_csv_roundtrip": _csv_roundtrip,
    "outcomes_normalized": _normalized,
    "outcomes_published": lambda s, d: published(s, d, "both"),
    "prev_close": lambda s, d: gaps.prev_close(unique(s, d)),
    "gaps_up": _gaps("up"),
    "gaps_down": _gaps("down"),
    "gaps_room_up": _gaps_room("up"),
    "gaps_room_down": _gaps_room("down"),
    "top_gaps_per_date": lambda s, d: gaps.top_gaps_per_date(candidates(s, d, "up")),
    "candles_of_gap_symbols": lambda s, d: bars_of(raw(s, d), candidates(s, d, "up")),
    "vwap_by_symbol": lambda s, d: gaps.vwap_by_symbol(unique(s, d)),
    "avwap_3d": lambda s, d: gaps.with_avwap_3d(unique(s, d)).select("symbol", "date", "anchored_vwap"),
    "sma_distances": lambda s, d: indicators.with_sma_distances(unique(s, d)).drop("open", "high", "low", "volume"),
    "sma_330_distance": lambda s, d: indicators.with_sma_distances(unique(s, d), [indicators.SMA_330]).select(
        "symbol", "date", "sma_330_distance_percent"
    ),
    "sma_330_strict": lambda s, d: indicators.with_sma_distances(unique(s, d), [indicators.SMA_330_STRICT]).select(
        "symbol", "date", "sma_330_distance_percent"
    ),
    "ema_21": lambda s, d: indicators.with_ema(unique(s, d)).select("symbol", "date", "ema_21"),
    "ema_full": lambda s, d: indicators.full_ema(unique(s, d), min_bars=21).withColumn("ema", F.round("ema", 6)),
    "avwap_anchors": lambda s, d: indicators.anchor_dates(raw(s, d).select("date").distinct()),
    "asof_close": _asof_close,
    "avwap_since": _avwap_since,
    "avwap_quarterly": lambda s, d: indicators.with_anchored_vwap_distances(unique(s, d), dates_of=raw(s, d)).drop(
        "open", "high", "low", "volume"
    ),
    "benchmark_gain": lambda s, d: indicators.with_benchmark_gain(candidates(s, d, "up"), unique(s, d)).select(
        "symbol", "date", "spy_daily_gain_percent"
    ),
    "forward_bars": lambda s, d: forward.forward_bars(followed(s, d, "up")),
    "forward_extremes": _measured(_horizons("lowest", "highest"), lambda t: t),
    "retrace_vwap": _retrace_vwap,
    "first_touch_250": _far_touches(None, 250),
    "first_touch_calendar_365": _far_touches(365, None),
    "retrace_ema21": _retrace_ema21("up"),
    "retrace_ema21_down": _retrace_ema21("down"),
    "forward_extremes_down": _measured(_horizons("lowest", "highest"), lambda t: t, "down"),
    "mfe_mae_down": _measured(
        _horizons("mfe_dollars", "mae_dollars", "mfe_percent", "mae_percent"), forward.with_excursions, "down"
    ),
    "retrace_percent_down": _measured(
        _horizons("retrace_percentage"), lambda t: forward.with_retrace_percent(t, "down"), "down"
    ),
    "gap_closure_down": _measured(
        _horizons("gap_closure_percentage", "gap_filled"), lambda t: forward.with_gap_closure(t, "down"), "down"
    ),
    "gap_outcomes_month": lambda s, d: gap_outcomes(raw(s, d), "up", *MONTH),
    "outcomes_upkept": _outcomes_upkept,
    "top_gap_outcomes": _top_gap_outcomes,
    "vwap_by_symbol_busy": lambda s, d: gaps.vwap_by_symbol(_busy(s, d)),
    "avwap_3d_busy": lambda s, d: gaps.with_avwap_3d(_busy(s, d)).select("symbol", "date", "anchored_vwap"),
    "avwap_quarterly_busy": lambda s, d: indicators.with_anchored_vwap_distances(_busy(s, d)).drop(
        "open", "high", "low", "volume"
    ),
    "mfe_mae": _measured(
        _horizons("mfe_dollars", "mae_dollars", "mfe_percent", "mae_percent"), forward.with_excursions
    ),
    "retrace_percent": _measured(_horizons("retrace_percentage"), lambda t: forward.with_retrace_percent(t, "up")),
    "gap_closure": _measured(
        _horizons("gap_closure_percentage", "gap_filled"), lambda t: forward.with_gap_closure(t, "up")
    ),
    "gap_outcomes_up": lambda s, d: gap_outcomes(raw(s, d), "up"),
    "gap_outcomes_down": lambda s, d: gap_outcomes(raw(s, d), "down"),
    "retrace_calendar_10d": _measured(
        ["retraced", "days_to_retrace", "retrace_percentage"], forward.retrace_from_open_calendar
    ),
    "mfe_mae_calendar_10d": _measured(
        ["mfe_dollars", "mae_dollars", "mfe_percent", "mae_percent"], forward.excursions_calendar
    ),
    "summary_by_date": _dated_summary,
    "summary_overall": lambda s, d: summary_overall(_dated_summary(s, d)),
    **{name: _report(report) for name, report in REPORTS.items()},
    **{f"{name}_long": _report(REPORTS[name], "down") for name in LONG_REPORTS},
    **{f"{name}_of_old_file": _report_of_old_file(name) for name in OLD_FILE_REPORTS},
    **{f"{name}_of_cube": _report_of_cube(name) for name in CUBE_REPORTS},
    "changes_only": level_changes,
    "distinct_blocks": _distinct_blocks,
    "grouped_first_seen": lambda s, d: keyed.group_in_first_seen_order(
        event_levels(s, d), "user_id", ["ts", "event_id"]
    ),
    "style_rules": _style_rules,
    "nested_rules": _nested_rules,
    "strip_comments": _strip_comments,
    "strip_comments_in_pieces": _strip_comments_in_pieces,
    "cleaned_rules": _cleaned_rules,
    "latest_snapshots": _latest_snapshots,
}
