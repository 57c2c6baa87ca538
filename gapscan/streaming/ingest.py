"""Picking up snapshot files as they land."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest_snapshots(
    spark: SparkSession,
    source: str,
    target: str,
    schema: StructType,
    checkpoint: str,
    every: str | None = "60 seconds",
    max_files: int = 1000,
) -> StreamingQuery:
    """Appends each parquet file that lands in source to target once, with its snapshot time.

    The snapshot time is the file's modification time. With every=None, all files
    there are now are taken up and the query ends. The checkpoint belongs on storage
    all executors share; a restart on it continues without loss or repetition. Each
    batch takes at most max_files files, so a backlog is worked off in steps.
    """
    landed = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(source)
        .select("*", F.col("_metadata.file_modification_time").alias("snapshot_time"))
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return (
        landed.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )
