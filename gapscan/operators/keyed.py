"""Changes per key: rows whose value differs from the one before, distinct blocks, order of first sight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes_only(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column | None
) -> DataFrame:
    """The rows whose value differs from the key's previous row; a first row stays.

    `chunk` cuts each key's history into pieces in order, e.g. the day of an event.
    Rows are compared within pieces, which can run in parallel for one key; only the
    first and last row of each piece then meet again by key. So a key that holds a
    large part of the table is not one task's work. Without a chunk (None), for histories that are known to be bounded, rows are compared
    in one window by key, which uses a partitioning by some of the keys that the table already has.
    """
    if chunk is None:
        before = F.lag(F.struct(F.col(value).alias("value"))).over(Window.partitionBy(*keys).orderBy(*order))
        linked = df.withColumn("_before", before)
        return linked.where(F.col("_before").isNull() | ~F.col("_before")["value"].eqNullSafe(F.col(value))).select(*df.columns)
    pieces = df.withColumn("_chunk", chunk).repartition(*keys, "_chunk")
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    # The value travels in a struct, to tell a null value from no previous row.
    current = F.struct(F.col(value).alias("value"))
    linked = pieces.withColumns({
        "_before": F.lag(current).over(within),
        "_last": F.lead(current).over(within).isNull(),
    }).withColumn("_first", F.col("_before").isNull())
    edges = linked.where("_first or _last")
    firsts = edges.withColumn(
        "_before", F.lag(current).over(Window.partitionBy(*keys).orderBy(*order))
    ).where("_first")
    changed = F.col("_before").isNull() | ~F.col("_before")["value"].eqNullSafe(F.col(value))
    return linked.where("not _first").unionByName(firsts).where(changed).select(*df.columns)


def distinct_blocks(
    changes: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], attribute: str, value: str, chunk: Column | None
) -> DataFrame:
    """Blocks of changed attributes, without those a key already had with the same content.

    One row per declaration of a block that stays: keys, block, ordinal, attribute, value. Of equal
    blocks of a key the first is kept. Blocks are told apart by their number of rows and two
    64-bit digests of ordinals and declarations, which are sums, so a block is never gathered; `chunk` cuts
    it into pieces in order that are numbered in parallel, as in changes_only. Without a chunk, for keys that are known to be bounded,
    blocks are numbered, summed and compared in windows by key.
    """
    if chunk is None:
        by_block = Window.partitionBy(*keys, block)
        numbered = changes.withColumn("ordinal", F.row_number().over(by_block.orderBy(*order)).cast("bigint"))
        content = ["ordinal", attribute, value, F.col(value).isNull()]
        # ordinals differ, so no two hashes of a block cancel out
        hashed = numbered.withColumns({f"_hash_{seed}": F.xxhash64(F.lit(seed), *content) for seed in (1, 2)})
        whole = by_block.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        digests = {"_n": F.max("ordinal").over(whole)} | {f"_digest_{seed}": F.bit_xor(f"_hash_{seed}").over(whole) for seed in (1, 2)}
        first = F.min(block).over(Window.partitionBy(*keys, "_n", "_digest_1", "_digest_2"))
        kept = hashed.withColumns(digests).withColumn("_first", first).where(F.col(block).eqNullSafe(F.col("_first")))
        return kept.select(*keys, block, "ordinal", attribute, value)
    within = Window.partitionBy(*keys, block, "_chunk").orderBy(*order)
    pieces = changes.withColumn("_chunk", chunk).withColumn("_local", F.row_number().over(within).cast("bigint"))
    earlier = Window.partitionBy(*keys, block).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy(*keys, block, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    numbered = _joined(pieces, starts, [*keys, block, "_chunk"]).select(
        *keys, block, (F.col("_local") + F.col("_start")).alias("ordinal"), attribute, value
    )
    # A null value differs from an empty text, so whether it is null counts as well.
    content = ["ordinal", attribute, value, F.col(value).isNull()]
    digests = [F.sum(F.xxhash64(F.lit(seed), *content).cast("decimal(38,0)")).alias(f"_digest_{seed}") for seed in (1, 2)]
    blocks = numbered.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"), *digests)
    firsts = blocks.groupBy(*keys, "_n", "_digest_1", "_digest_2").agg(F.min(block).alias(block)).select(*keys, block)
    return _joined(numbered, firsts, [*keys, block])


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows with what the right has for the same key, null keys included."""
    named = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(named, same).drop(*[f"_right_{c}" for c in on])


def group_in_first_seen_order(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """All rows, keys in the order they first appear, rows of a key in their own order.

    Adds first_<column> for each order column. The groups stay rows rather than lists,
    so no group has to fit into one task.
    """
    position = F.struct(*order)
    first = df.groupBy(key).agg(F.min(position).alias("_first"))
    first = first.select(F.col(key).alias("_key"), *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order])
    placed = df.join(first, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return placed.orderBy(*[f"first_{c}" for c in order], *order)
