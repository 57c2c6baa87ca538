"""De-duplication of bars that arrive as a stream: the most traded bar of a symbol and date wins, also when it comes later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapscan.schema import BAR_COLUMNS
from gapscan.sources.bars import bars, dedupe_bars

#: What decides between bars of one symbol and date, in this order.
RANK = ("volume", "open", "close", "high", "low")


def _best() -> Column:
    """The bar that `dedupe_bars` keeps: as a struct the largest one, unknown prices lowest."""
    return F.max(F.struct(*RANK)).alias("best")


def best_bars(arriving: DataFrame, late: str = "7 days") -> DataFrame:
    """Of a stream of bars, each symbol's and date's best one so far, again whenever it changes (output mode update).

    State is one bar per symbol and date, combined before the shuffle, and is dropped once the watermark, `late` behind the newest date
    seen, has passed the date; bars that come later than that are ignored. A bar without a date has no place in time and is left out.
    """
    typed = bars(arriving).where("date is not null").withColumn("day", F.to_timestamp("date"))
    best = typed.withWatermark("day", late).groupBy("symbol", "day").agg(_best())
    return best.select("symbol", F.to_date("day").alias("date"), *[f"best.{c}" for c in RANK]).select(*BAR_COLUMNS)


class Corrections:
    """A table of bars that a stream improves on: a folder per batch, so that a batch that is run again replaces itself."""

    def __init__(self, target: str):
        self.target = target

    def __call__(self, improved: DataFrame, batch: int) -> None:
        improved.write.mode("overwrite").parquet(f"{self.target}/batch={batch}")

    def bars(self, spark: SparkSession) -> DataFrame:
        """The current bars. A correction beats what it corrects by the rank, so their order of arrival does not matter."""
        schema = ", ".join(f"{name} {kind}" for name, kind in BAR_COLUMNS.items())
        return dedupe_bars(spark.read.schema(schema + ", batch bigint").parquet(self.target).drop("batch"))

    def compact(self, spark: SparkSession, into: str) -> Corrections:
        """Another table with the current bars only."""
        self.bars(spark).write.parquet(f"{into}/batch=-1")
        return Corrections(into)


def dedupe_stream(
    arriving: DataFrame, target: str, checkpoint: str, late: str = "7 days", every: str | None = "60 seconds"
) -> StreamingQuery:
    """Keeps `Corrections(target).bars` equal to `dedupe_bars` of all bars that came in time.

    With every=None, what there is now is taken up and the query ends. The checkpoint belongs on storage all executors share; a restart
    on it continues without loss or repetition.
    """
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (
        best_bars(arriving, late)
        .writeStream.foreachBatch(Corrections(target))
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
