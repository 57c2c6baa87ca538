"""Shards of nearly equal size by sampled splitters.

Records are ordered by a hash of their text, then id, so that equal texts are
neighbours. A size-weighted sample of keys gives splitters at equal quantiles; records
are range-partitioned by them, and ranges that turn out overfull are subdivided by
further samples. The exact sizes of all ranges, summed up, place each range on the line of
all bytes; a running sum within a range places each record, and equal stretches of the
line are the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapscan.llm.common import written

RANGES_A_SHARD = 8
ROWS_A_RANGE = 500_000
SAMPLES_A_RANGE = 32
RECORD_BYTES = 16


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two signed 64-bit values as bytes that sort like them; a last byte keeps zeros significant."""
    out = np.ones((len(high), 17), np.uint8)
    for k, values in enumerate((high, low)):
        shifted = (values.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
        out[:, 8 * k : 8 * k + 8] = shifted.view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def _range_of(splitters: np.ndarray):
    """Column function: how many splitters a key is at or above. Splitters number RANGES, not records."""

    @F.pandas_udf("int")
    def find(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for high, low in parts:
            yield pd.Series(np.searchsorted(splitters, _packed(high.to_numpy(), low.to_numpy()), "right").astype(np.int32))

    return find(F.col("key"), F.coalesce("doc_id", F.lit(-1)))


def _sample(records: DataFrame, rate: float, seed: int) -> list:
    """Keys drawn with a chance of size x rate, at most 1, by hash: the same on every attempt."""
    chance = (F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)) < F.col("size") * rate
    return records.where(chance).select("key", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "size").collect()


def _quantiles(sample: list, rate: float, n: int) -> np.ndarray:
    """n - 1 boundaries that cut the weight of the sample into n equal parts."""
    if not sample:
        return np.zeros(0, "S17")
    keys = _packed(np.array([r[0] for r in sample]), np.array([r[1] for r in sample]))
    order = np.argsort(keys)
    weights = np.cumsum(np.maximum(1.0, np.array([r[2] for r in sample]) * rate)[order])
    at = np.searchsorted(weights, weights[-1] * np.arange(1, n) / n)
    return np.unique(keys[order][np.minimum(at, len(order) - 1)])


def shard_by_size(docs: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each document; sizes of shards differ by about one record.

    Size is the text's UTF-8 bytes plus 16; a null text has none, an empty text has none
    either. Null ids sort before others; repeated rows are placed one by one. An empty table gives no
    rows; other columns are ignored.
    """
    records = written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("bigint").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        )
    )
    total, rows, largest = records.agg(F.sum("size"), F.count("*"), F.max("size")).first()
    total = total or 1
    n = max(RANGES_A_SHARD * shards, -(-rows // ROWS_A_RANGE))
    rate = n * SAMPLES_A_RANGE / total
    splitters = _quantiles(_sample(records, rate, 0), rate, n)
    overfull = 2 * total / n
    for seed in range(1, 1 << 30):
        placed = records.withColumn("range", _range_of(splitters))
        filled = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("most"))
        ranges = filled.orderBy("range").collect()  # as many as splitters
        # one record, or records with one key, cannot be divided; those larger than a range stand alone anyway
        large = [r["range"] for r in ranges if r["bytes"] - r["most"] > overfull]
        if not large:
            break
        finer = placed.where(F.col("range").isin(large))
        more = _sample(finer, rate * 2**seed, seed)
        grown = np.unique(np.concatenate([splitters, _quantiles(more, rate * 2**seed, 8 * len(large))]))
        if len(grown) == len(splitters):
            break
        splitters = grown
    before = []
    bytes_before = rows_before = 0
    for r in ranges:
        before.append((r["range"], bytes_before, rows_before))
        bytes_before += r["bytes"]
        rows_before += r["rows"]
    starts = docs.sparkSession.createDataFrame(before, "range int, bytes_before bigint, rows_before bigint")
    within = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32")
    line = (
        placed.join(F.broadcast(starts), "range")
        .withColumn("place", F.row_number().over(within) - 1 + F.col("rows_before"))
        .withColumn("start", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("bytes_before"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(start + size div 2) * {shards} div {total}")).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "place")
    )
    line = written(line)
    first = line.groupBy("shard").agg(F.min("place").alias("first"))  # a row a shard
    return line.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
