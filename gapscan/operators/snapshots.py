"""Retention of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_snapshots(df: DataFrame, snapshot: str, n: int = 10) -> DataFrame:
    """The rows of the newest n snapshots.

    The newest n are a top-n over distinct values, n rows however many there are, so
    broadcasting them is safe.
    """
    newest = df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().orderBy(F.desc(snapshot)).limit(n)
    return df.join(F.broadcast(newest), snapshot, "left_semi")
