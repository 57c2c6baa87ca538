"""Snapshots of which only the newest stay, while they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType, TimestampType

from gapscan.sources.folders import Folders

SNAPSHOT, BATCH = "snapshot_time", "batch"


def _micros(name: str) -> int | None:
    key, _, value = name.partition("=")
    return int(value) if key == SNAPSHOT else None


class Retention:
    """Keeps the newest n snapshots of what lands in batches, in a table with a folder for each snapshot and batch.

    A batch adds its rows to their snapshots' folders, under its own number, so that a batch that is run again replaces what it wrote
    before. Then folders of snapshots that are no longer among the newest n go. What a late file brings to a snapshot that is
    kept is added to it; a snapshot that is older than all kept ones is never written. Readers of `rows` see whole snapshots only
    between batches.
    """

    def __init__(self, target: str, n: int = 10):
        if n < 1:
            raise ValueError("at least one snapshot has to stay")
        self.target, self.n = target, n

    def __call__(self, landed: DataFrame, batch: int) -> None:
        spark = landed.sparkSession
        folders = Folders(spark, self.target)
        known = {m for m in map(_micros, folders.names()) if m is not None}
        rows = landed.where(F.col(SNAPSHOT).isNotNull()).withColumn(SNAPSHOT, F.unix_micros(SNAPSHOT))
        # the newest n of the batch are a top-n over distinct values, n rows however many there are
        fresh = {r[0] for r in rows.select(SNAPSHOT).distinct().orderBy(F.desc(SNAPSHOT)).limit(self.n).collect()}
        kept = sorted(known | fresh, reverse=True)[: self.n]
        if fresh & set(kept):
            (
                rows.where(F.col(SNAPSHOT).isin(*kept))
                .withColumn(BATCH, F.lit(batch))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(SNAPSHOT, BATCH)
                .parquet(self.target)
            )
        for old in known - set(kept):
            folders.delete(f"{SNAPSHOT}={old}")

    def rows(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The kept rows with their snapshot time."""
        full = StructType([*schema.fields]).add(SNAPSHOT, LongType()).add(BATCH, LongType())
        if not Folders(spark, self.target).names():
            return spark.createDataFrame([], StructType([*schema.fields]).add(SNAPSHOT, TimestampType()))
        table = spark.read.schema(full).parquet(self.target)
        return table.withColumn(SNAPSHOT, F.timestamp_micros(SNAPSHOT)).drop(BATCH)


def retain_snapshots(
    spark: SparkSession,
    source: str,
    target: str,
    schema: StructType,
    checkpoint: str,
    n: int = 10,
    every: str | None = "60 seconds",
    max_files: int = 1000,
    snapshot: str | None = None,
) -> StreamingQuery:
    """Takes up each parquet file that lands in source once and keeps the newest n snapshots in target as they land.

    A row's snapshot is the `snapshot` column, else its file's modification time; rows without one are left out. At every moment
    between batches `Retention(target, n).rows` equals `latest_snapshots` of all that has landed. With every=None, all files there
    are now are taken up and the query ends; a restart on the checkpoint continues without loss or repetition.
    """
    landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    landed = landed.withColumn(SNAPSHOT, F.col(snapshot).cast("timestamp") if snapshot else F.col("_metadata.file_modification_time"))
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return landed.writeStream.foreachBatch(Retention(target, n)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
