"""Daily bars: reading, de-duplicating, storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapscan.functions.columns import add
from gapscan.schema import BAR_COLUMNS


def read_bars(spark: SparkSession, source: str, format: str | None = None, **options: str) -> DataFrame:
    """Bars from a table name, or from a path when a format is given.

    Any Spark source works. For format="jdbc" pass the connection options, with
    partitionColumn, lowerBound, upperBound and numPartitions for a parallel read.
    """
    if format is None:
        return bars(spark.table(source))
    reader = spark.read.format(format).options(**options)
    return bars(reader.option("dbtable", source).load() if format == "jdbc" else reader.load(source))


def bars(df: DataFrame) -> DataFrame:
    """The bar columns with their types.

    A missing volume counts as none traded; a price that is not a number is unknown.
    """
    def typed(name: str, kind: str) -> str:
        if name == "volume":
            return "cast(coalesce(volume, 0) as bigint) as volume"
        if kind == "double":
            return f"nullif(cast({name} as double), double('NaN')) as {name}"
        return f"cast({name} as {kind}) as {name}"

    return df.selectExpr(*[typed(name, kind) for name, kind in BAR_COLUMNS.items()])


def dedupe_bars(df: DataFrame) -> DataFrame:
    """One bar per symbol and date: most volume, then highest open, close, high, low.

    Spark plans this as a group limit that already runs before the shuffle, so a
    symbol, or a single bar, that makes up a large part of the raw rows sends at most
    one row per date and map task. Afterwards a symbol has at most one row per
    calendar day, which bounds every later window by symbol.
    """
    # where it is never missing it is ordered by as it is, so that the shuffle has no column more and is the same for all that is read of the bars
    volume = "coalesce(volume, 0)" if df.select("volume").schema[0].nullable else "volume"
    best_first = f"{volume} desc, open desc, close desc, high desc, low desc"
    ranked = add(df, {"_copy": f"row_number() over (partition by symbol, date order by {best_first})"})
    return ranked.where("_copy = 1").drop("_copy")


#: A bound that leaves its side open.
OPEN = "open"


def in_dates(start: str | None = None, end: str | None = None) -> Column:
    """Whether a row's date lies in [start, end]; by default in the last 30 days. A bound of OPEN is none."""
    inside = F.col("date").isNotNull()
    if start != OPEN:
        inside &= F.col("date") >= (F.to_date(F.lit(start)) if start else F.date_sub(F.current_date(), 30))
    if end != OPEN:
        inside &= F.col("date") <= (F.to_date(F.lit(end)) if end else F.current_date())
    return inside


def around_dates(df: DataFrame, start: str | None, end: str | None, days: int, before: int, after: int) -> DataFrame:
    """The bars that measures of the dates in [start, end] can look at; None leaves a side open.

    Kept are all dates from `days` before the quarter of `start` up to `end`, and of each
    symbol the last `before` dates earlier than that and the first `after` dates later than `end`. The
    two are rank limits, which Spark applies before it shuffles; dates between go to the scan as a filter.
    Bars without a date come before all others.
    """
    inside, parts = F.lit(True), []
    by_symbol = Window.partitionBy("symbol")
    if start is not None:
        first = F.date_sub(F.trunc(F.to_date(F.lit(start)), "quarter"), days)
        inside &= F.col("date") >= first
        earlier = df.where((F.col("date") < first) | F.col("date").isNull())
        rank = F.dense_rank().over(by_symbol.orderBy(F.desc_nulls_last("date")))
        parts.append(earlier.withColumn("_rank", rank).where(F.col("_rank") <= before).drop("_rank"))
    if end is not None:
        last = F.to_date(F.lit(end))
        inside &= (F.col("date") <= last) if start is not None else (F.col("date") <= last) | F.col("date").isNull()
        rank = F.dense_rank().over(by_symbol.orderBy("date"))
        parts.append(df.where(F.col("date") > last).withColumn("_rank", rank).where(F.col("_rank") <= after).drop("_rank"))
    kept = df.where(inside)
    for part in parts:
        kept = kept.unionByName(part)
    return kept


def trading_dates(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Distinct dates of the bars in [start, end], ascending; by default of the last 30 days."""
    return df.where(in_dates(start, end)).select("date").distinct().orderBy("date")


def bars_of(df: DataFrame, symbols: DataFrame) -> DataFrame:
    """The bars whose symbol occurs in the other table."""
    return df.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def save_bucketed(df: DataFrame, table: str, buckets: int) -> None:
    """Store bars bucketed by symbol, so that gap jobs on the table need no shuffle."""
    (
        df.repartition(buckets, "symbol")
        .write.mode("overwrite")
        .bucketBy(buckets, "symbol")
        .sortBy("symbol", "date")
        .saveAsTable(table)
    )
