"""Half-open value buckets and tables that keep their empty buckets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Buckets:
    """Labelled buckets [edge, next edge); values outside all of them have none."""

    edges: Sequence[float]
    labels: Sequence[str]

    def __post_init__(self) -> None:
        if len(self.labels) != len(self.edges) - 1:
            raise ValueError("there must be one label per pair of neighbouring edges")

    def ordinal(self, value: Column) -> Column:
        """Bucket number from 0, or null outside the edges."""
        number = F.when(value < self.edges[0], F.lit(None).cast("int"))
        for i, upper in enumerate(self.edges[1:]):
            number = number.when(value < upper, F.lit(i))
        return number

    def complete(self, per_bucket: DataFrame, counts: Sequence[str] = ()) -> DataFrame:
        """One row per bucket, in order, from a table keyed by bucket_no.

        Buckets without rows get null measures and zero counts. Both sides have at
        most one row per bucket, so the join is broadcast whatever the data size.
        """
        spark = per_bucket.sparkSession
        names = F.array(*[F.lit(label) for label in self.labels])
        dimension = spark.range(0, len(self.labels), 1, 1).select(
            F.col("id").cast("int").alias("bucket_no"),
            F.get(names, F.col("id").cast("int")).alias("bucket"),
        )
        table = dimension.join(F.broadcast(per_bucket), "bucket_no", "left")
        return table.fillna(0, subset=list(counts)) if counts else table


# Bucket edges and labels of the report tables.
GAP_SIZE = Buckets(
    [2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 100],
    ["2-3%", "3-4%", "4-5%", "5-6%", "6-7%", "7-8%", "8-9%", "9-10%", "10-12%", "12-15%", "15-20%", "20%+"],
)
GAP_WIDE = Buckets(
    [2, 3, 4, 5, 7.5, 10, 15, 25, 50, 100],
    ["2–3", "3–4", "4–5", "5–7.5", "7.5–10", "10–15", "15–25", "25–50", "50–100"],
)
AVWAP_DISTANCE = Buckets(
    [0, 1, 2, 3, 5, 8, 12, 20, 1000],
    ["0–1", "1–2", "2–3", "3–5", "5–8", "8–12", "12–20", "20%+"],
)
SMA_DISTANCE = Buckets(
    [-1000, -20, -12, -8, -5, -3, -1, 0, 1, 3, 5, 8, 12, 20, 1000],
    ["<=-20", "-20–-12", "-12–-8", "-8–-5", "-5–-3", "-3–-1", "-1–0",
     "0–1", "1–3", "3–5", "5–8", "8–12", "12–20", ">=20"],
)
BENCHMARK_CHANGE = Buckets(
    [-5, -3, -2, -1, -0.5, 0, 0.5, 1, 2, 3, 5],
    ["<-3", "-3–-2", "-2–-1", "-1–-0.5", "-0.5–0", "0–0.5", "0.5–1", "1–2", "2–3", ">3"],
)
