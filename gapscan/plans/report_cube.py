"""All grouped report tables from one pass over the outcomes.

Every outcome is counted under each of its keys: its date, its gap size, its buckets, its side of each level, its days to retrace.
All groups share one set of sums, which are combined before the one shuffle; what is left has a row per date, bucket,
side and different gap, however many outcomes there are. Years, months and totals are sums over dates. Each report table is a projection of these few rows
and equals the one that `reports` makes by a pass of its own. Sums of cubes add up, so a cube can be kept by date range and merged.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscan.functions import buckets
from gapscan.functions.buckets import Buckets
from gapscan.functions.measures import flag, known, ratio_or_infinity, retrace_fraction
from gapscan.plans import reports
from gapscan.schema import HORIZONS

#: Columns that a table must have known for a report to speak of them.
MEASURED = [f"{c}_{h}d" for h in HORIZONS for c in ("retraced_to_vwap", "retrace_percentage", "gap_filled", "retraced_to_21ema")]
LEVELS = {**reports.ABOVE_BELOW_LEVELS, "330-SMA": "sma_330_distance_percent"}

BUCKETED = {
    "gap_size": (buckets.GAP_SIZE, lambda: F.col("gap_up_percent")),
    "gap_wide": (buckets.GAP_WIDE, lambda: F.col("gap_up_percent")),
    "avwap": (buckets.AVWAP_DISTANCE, reports.room_percent),
    "sma330": (buckets.SMA_DISTANCE, lambda: F.col("sma_330_distance_percent")),
    "benchmark": (buckets.BENCHMARK_CHANGE, lambda: F.col("spy_daily_gain_percent")),
}


def _measures() -> dict[str, Column]:
    """What is summed of each outcome; whole numbers and decimals, so sums do not depend on their order."""
    out = {
        "n": F.lit(1).cast("bigint"),
        "tickers": F.col("ticker").isNotNull().cast("bigint"),
        "spy_n": F.col("spy_daily_gain_percent").isNotNull().cast("bigint"),
        "spy": F.col("spy_daily_gain_percent").cast("decimal(26,8)"),
    }
    for h in HORIZONS:
        fraction = F.coalesce(retrace_fraction(f"retrace_percentage_{h}d"), F.lit(0.0))
        out |= {
            f"retraced_{h}": flag(f"retraced_to_vwap_{h}d").cast("bigint"),
            f"judged_{h}": F.col(f"retraced_to_vwap_{h}d").isNotNull().cast("bigint"),
            f"filled_{h}": flag(f"gap_filled_{h}d").cast("bigint"),
            f"ema_{h}": flag(f"retraced_to_21ema_{h}d").cast("bigint"),
            f"won_{h}": fraction.cast("decimal(26,8)"),
            f"lost_{h}": (1 - fraction).cast("decimal(26,8)"),
            f"pnl_{h}": reports.pnl(h).cast("decimal(18,6)"),
        }
    return out


def _keys() -> Column:
    """All (kind, key, gap) that an outcome counts under; a missing date is a key too."""
    none, no_gap = F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def key(kind: str, value: Column, there: Column | None = None, gap: Column = no_gap) -> Column:
        entry = F.struct(F.lit(kind).alias("kind"), value.cast("bigint").alias("key"), gap.alias("gap"))
        return entry if there is None else F.when(there, entry)

    keys = [key("date", F.unix_date("date")), key("gap", none, F.col("gap_up_percent").isNotNull(), F.col("gap_up_percent"))]
    for kind, (which, value) in BUCKETED.items():
        number = which.ordinal(value())
        keys.append(key(kind, number, number.isNotNull()))
    for level, column in LEVELS.items():
        keys.append(key(level, F.when(F.col(column) >= 0, 0).otherwise(1), F.col(column).isNotNull()))
    for h in HORIZONS:
        days = F.col(f"days_to_retrace_{h}d")
        keys.append(key(f"days_{h}", days, F.col(f"retraced_to_vwap_{h}d") & days.isNotNull()))
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def _share(part: str, of: str) -> Column:
    return F.when(F.col(of) > 0, F.col(part) / F.col(of) * 100)


@dataclass
class Cube:
    """The sums by (kind, key, gap), the columns that are known, and the report tables made of them."""

    sums: DataFrame
    known: frozenset[str]

    @staticmethod
    def of(outcomes: DataFrame) -> Cube:
        """One scan of published outcomes."""
        measures = _measures()
        counted = outcomes.select(F.explode(_keys()).alias("k"), "direction", *[m.alias(name) for name, m in measures.items()])
        grouped = counted.groupBy("k.kind", "k.key", "k.gap")
        sums = grouped.agg(F.max("direction").alias("direction"), *[F.sum(name).alias(name) for name in measures])
        return Cube(sums, frozenset(c for c in MEASURED if known(outcomes, c)))

    def merged(self, others: Iterable[Cube]) -> Cube:
        """The cube of all outcomes of several cubes; known is what all of them know."""
        sums, common = self.sums, self.known
        for other in others:
            sums, common = sums.unionByName(other.sums), common & other.known
        return Cube(sums.groupBy("kind", "key", "gap").agg(*_added()), common)

    # --- groups ------------------------------------------------------------------------------

    def kind(self, kind: str) -> DataFrame:
        return self.sums.where(F.col("kind") == kind)

    def dates(self) -> DataFrame:
        return self.kind("date").where("key is not null").withColumn("date", F.date_from_unix_date(F.col("key").cast("int")))

    def total(self) -> DataFrame:
        return self.kind("date").agg(F.count("key").alias("dates"), *_added())

    def has(self, column: str, measure: Column, kind: str = "double") -> Column:
        return measure if column in self.known else F.lit(None).cast(kind)

    # --- reports -----------------------------------------------------------------------------

    def header(self) -> DataFrame:
        return self.total().select(
            F.coalesce("n", F.lit(0)).cast("bigint").alias("row_count"), F.col("dates").alias("date_count"), F.coalesce("direction", F.lit("unknown")).alias("direction")
        )

    def overall_rates(self) -> DataFrame:
        parts = {"avwap": ("retraced", "retraced_to_vwap"), "ema21": ("ema", "retraced_to_21ema"), "gap_fill": ("filled", "gap_filled")}
        return self.total().select(*[
            F.round(self.has(f"{column}_{h}d", _share(f"{part}_{h}", "n")), 2).alias(f"{name}_rate_{h}d") for name, (part, column) in parts.items() for h in HORIZONS
        ])

    def profit_factor_overall(self) -> DataFrame:
        factor = lambda h: F.coalesce(F.round(_factor(h), 2), F.lit(0.0))
        return self.total().select(*[self.has(f"retrace_percentage_{h}d", factor(h)).alias(f"profit_factor_{h}d") for h in HORIZONS])

    def performance(self, h: int) -> list[Column]:
        wins = lambda part: ratio_or_infinity(F.col(f"{part}_{h}"), F.col("n") - F.col(f"{part}_{h}"))
        return [
            F.col("n").alias("trades"),
            *[reports.two_decimals(self.has(f"{column}_{h}d", measure)).alias(name) for name, column, measure in (
                ("avwap_rate", "retraced_to_vwap", _share(f"retraced_{h}", "n")), ("avwap_pf", "retrace_percentage", _factor(h)),
                ("gap_close_rate", "gap_filled", _share(f"filled_{h}", "n")), ("gap_close_pf", "gap_filled", wins("filled")),
                ("ema21_rate", "retraced_to_21ema", _share(f"ema_{h}", "n")), ("ema21_pf", "retraced_to_21ema", wins("ema")),
            )],
        ]

    def performance_by_year(self, h: int) -> DataFrame:
        return self.dates().groupBy(F.year("date").alias("year")).agg(*_added()).select("year", *self.performance(h)).orderBy("year")

    def by_bucket(self, kind: str, columns: list[Column], counts: list[str] = []) -> DataFrame:  # noqa: B006
        which: Buckets = BUCKETED[kind][0]
        return which.complete(self.kind(kind).select(F.col("key").cast("int").alias("bucket_no"), *columns), counts).orderBy("bucket_no")

    def performance_by_gap_size(self, h: int) -> DataFrame:
        return self.by_bucket("gap_size", self.performance(h), ["trades"])

    def win_by(self, kind: str, h: int) -> DataFrame:
        return self.by_bucket(kind, [self.has(f"retraced_to_vwap_{h}d", _share(f"retraced_{h}", "n")).alias("rate")])

    def retrace_by_gap_bucket(self) -> DataFrame:
        return self.by_bucket("gap_wide", [F.col("tickers").alias("total"), _share("retraced_10", "judged_10").alias("rate10")], ["total"])

    def months(self) -> DataFrame:
        return self.dates().groupBy(F.trunc("date", "month").alias("month")).agg(*_added())

    def monthly_sma5(self) -> DataFrame:
        monthly = self.months().select(
            "month", F.col("tickers").alias("total"), *[self.has(f"retraced_to_vwap_{h}d", F.col(f"retraced_{h}"), "bigint").alias(f"retraced{h}") for h in HORIZONS]
        )
        rated = monthly.withColumns({f"rate{h}": F.when(F.col("total") > 0, F.col(f"retraced{h}") * 100 / F.col("total")) for h in HORIZONS})
        return rated.withColumns({f"sma{h}": reports.trailing_mean(f"rate{h}", 5) for h in HORIZONS}).orderBy("month")

    def monthly_win(self, h: int) -> DataFrame:
        rates = self.months().where(F.lit(f"retraced_to_vwap_{h}d" in self.known)).select("month", _share(f"retraced_{h}", "n").alias("rate"))
        return rates.withColumn("ma14", reports.trailing_mean("rate", 14)).orderBy("month")

    def monthly_win_both(self) -> DataFrame:
        each = [F.struct(F.lit(f"{h}d").alias("horizon"), _share(f"retraced_{h}", "n").alias("rate")) for h in HORIZONS if f"retraced_to_vwap_{h}d" in self.known]
        empty = F.array().cast("array<struct<horizon:string,rate:double>>")
        return self.months().select("month", F.explode(F.array(*each) if each else empty).alias("r")).select("month", "r.*").orderBy("month", "horizon")

    def gaps(self) -> DataFrame:
        return self.kind("gap").select("gap", "n")

    def gap_box(self) -> DataFrame:
        return reports.box_of(self.gaps().groupBy(F.round("gap", 2).alias("gap")).agg(F.sum("n").alias("n")))

    def above_below(self, levels: Iterable[str]) -> DataFrame:
        sides = self.sums.where(F.col("kind").isin(*levels)).withColumn("side", F.when(F.col("key") == 0, "Above").otherwise("Below"))
        each = [F.struct(F.lit(f"{h}d").alias("horizon"), _share(f"retraced_{h}", "n").alias("rate")) for h in HORIZONS if f"retraced_to_vwap_{h}d" in self.known]
        empty = F.array().cast("array<struct<horizon:string,rate:double>>")
        return sides.select(F.col("kind").alias("level"), "side", F.explode(F.array(*each) if each else empty).alias("r")).select("level", "side", "r.*")

    def pnl_totals(self) -> DataFrame:
        return self.total().select(*[F.col(f"pnl_{h}").cast("double").alias(f"total_pnl_{h}d") for h in HORIZONS])

    def days_to_retrace(self, h: int) -> DataFrame:
        counts = self.kind(f"days_{h}").select(F.col("key").cast("int").alias("day"), F.col("n").alias("count"))
        return counts.withColumn("percentage", F.col("count") / F.sum("count").over(Window.partitionBy()) * 100).orderBy("day")

    def benchmark_vs_retrace(self) -> DataFrame:
        spy = F.when(F.col("spy_n") > 0, F.col("spy").cast("double") / F.col("spy_n"))
        return self.dates().select("date", spy.alias("spy"), _share("retraced_10", "judged_10").alias("rate10")).orderBy("date")

    def reports(self) -> dict[str, DataFrame]:
        """All report tables that are made of groups, by the names they have in `reports.REPORTS`."""
        each = lambda name, make: {f"{name}_{h}d": make(h) for h in HORIZONS}
        return {
            "report_header": self.header(),
            "overall_rates": self.overall_rates(),
            "profit_factor_overall": self.profit_factor_overall(),
            **each("perf_by_year", self.performance_by_year),
            **each("perf_by_gap_size", self.performance_by_gap_size),
            "monthly_sma5": self.monthly_sma5(),
            **each("monthly_win", self.monthly_win),
            "monthly_win_both": self.monthly_win_both(),
            "gap_histogram": reports.histogram_of(self.gaps()),
            "gap_box": self.gap_box(),
            "retrace_by_gap_bucket": self.retrace_by_gap_bucket(),
            **each("win_by_gap", lambda h: self.win_by("gap_wide", h)),
            **each("win_by_avwap_distance", lambda h: self.win_by("avwap", h)),
            "win_above_below": self.above_below(reports.ABOVE_BELOW_LEVELS),
            "win_above_below_330": self.above_below(["330-SMA"]),
            **each("win_by_sma330", lambda h: self.win_by("sma330", h)),
            **each("win_by_benchmark", lambda h: self.win_by("benchmark", h)),
            "pnl_totals": self.pnl_totals(),
            **each("days_to_retrace", self.days_to_retrace),
            "benchmark_vs_retrace": self.benchmark_vs_retrace(),
            "benchmark_trend": reports.trend_of(self.benchmark_vs_retrace()),
        }


def _factor(h: int) -> Column:
    return ratio_or_infinity(F.col(f"won_{h}").cast("double"), F.col(f"lost_{h}").cast("double"))


def _added() -> list[Column]:
    return [F.max("direction").alias("direction"), *[F.sum(name).alias(name) for name in _measures()]]
