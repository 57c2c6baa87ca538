"""Bars derived from the lineitem test table: one per line, plus a market benchmark.

The arithmetic stays in whole cents until the last step. Several lines share a
supplier and a day, which gives duplicate bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("k"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("e"),
        F.rint("l_quantity").cast("bigint").alias("volume"),
    )
    season = lines.withColumn("ym", F.expr("cast(year(date) * 6 + (month(date) - 1) div 2 as bigint)"))
    level = season.withColumn("lvl", F.expr("5000 + ((k * 7919 + ym * (104729 + k * 97) + ym * ym * 331) % 2500)"))
    cents = level.select(
        F.expr("concat('S', k)").alias("symbol"),
        "date",
        F.expr("lvl + e % 400").alias("o"),
        F.expr("lvl + (e div 7) % 400").alias("c"),
        "e",
        "volume",
    )
    supplier_bars = cents.select(
        "symbol",
        "date",
        F.expr("o / 100D").alias("open"),
        F.expr("(greatest(o, c) + e % 97) / 100D").alias("high"),
        F.expr("(least(o, c) - e % 89) / 100D").alias("low"),
        F.expr("c / 100D").alias("close"),
        "volume",
    )
    per_day = lines.groupBy("date").agg(F.sum("e").alias("s"), F.count(F.lit(1)).alias("n"))
    benchmark_bars = per_day.select(
        F.lit("SPY").alias("symbol"),
        "date",
        F.expr("(40000 + s % 2000) / 100D").alias("open"),
        F.lit(420.0).alias("high"),
        F.lit(400.0).alias("low"),
        F.expr("(40000 + (s div 7) % 2000) / 100D").alias("close"),
        F.col("n").alias("volume"),
    )
    return supplier_bars.unionByName(benchmark_bars)
