"""Lookups in a second table by time: the last row before each row, and sums since an anchor that each row names."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscan.functions.prices import TYPICAL, VWAP_SUMS, percent_from, vwap, vwap_sums
from gapscan.functions.columns import add

Piece = Callable[[Column], Column]


def by_quarter(time: Column) -> Column:
    """Pieces of a quarter each."""
    return F.date_trunc("quarter", time.cast("timestamp"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    values: Mapping[str, str],
    *,
    strict: bool = True,
    ties: Sequence[str] = (),
    piece: Piece = by_quarter,
) -> DataFrame:
    """Left rows with columns of the key's last right row before them (strict) or not after them; null where there is none.

    `values` maps names of the right table to names in the result. Of right rows at the same time the one with the largest `ties` counts, then
    the one with the largest values. Both tables go through one sorted union, in which the last right row is carried on: no row meets
    more than one other. A key's rows are cut into pieces of time by `piece`, which must not decrease with time; pieces
    are sorted in parallel, and each begins with what the pieces before it ended with, of which there is one row a piece. So a key with
    most rows is not one task's work. Rows of either table without a time, or without a key, match nothing.
    """
    carried = list(values.values())
    clash = set(carried) & set(left.columns)
    if clash:
        raise ValueError(f"the left table has columns {sorted(clash)} already")
    row = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)], *[F.col(c).alias(n) for c, n in values.items()])
    timed = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(key).alias("_key"), F.col(right_time).cast("timestamp").alias("_time"), row.alias("_row")
    )
    timed = timed.withColumn("_piece", piece(F.col("_time")))
    asked = left.withColumns({"_key": F.col(key), "_time": F.col(left_time).cast("timestamp"), "_own": F.struct(*left.columns)})
    asked = asked.select("_own", "_key", "_time", piece(F.col("_time")).alias("_piece"))
    # the last row of each piece, and of all pieces before it
    ends = timed.groupBy("_key", "_piece").agg(F.max(F.struct("_time", "_row")).alias("_end"))
    begun = asked.where("_key is not null and _time is not null").select("_key", "_piece").distinct()
    kind = ends.schema["_end"].dataType
    edges = ends.unionByName(begun.withColumn("_end", F.lit(None).cast(kind))).groupBy("_key", "_piece").agg(F.max("_end").alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).where("_before is not null")
    none = F.lit(None).cast(asked.schema["_own"].dataType)
    # at one time a right row comes first if it may count, and after the left ones if it may not
    side = 2 if strict else 0
    rows = asked.withColumns({"_side": F.lit(1), "_row": F.lit(None).cast(timed.schema["_row"].dataType)})
    rows = rows.unionByName(timed.withColumns({"_side": F.lit(side), "_own": none}))
    rows = rows.unionByName(edges.select("_key", "_piece", F.lit(None).cast("timestamp").alias("_time"), F.lit(-1).alias("_side"), F.col("_before._row").alias("_row")).withColumn("_own", none))
    order = Window.partitionBy("_key", "_piece").orderBy(F.asc_nulls_first("_time"), "_side", "_row")
    known = F.col("_key").isNotNull() & F.col("_time").isNotNull()
    found = rows.withColumn("_found", F.last("_row", ignorenulls=True).over(order)).where("_own is not null")
    found = found.withColumn("_found", F.when(known, F.col("_found")))
    return found.select("_own.*", *[F.col(f"_found.{n}").alias(n) for n in carried])


def avwap_since(rows: DataFrame, bars: DataFrame, anchor: str, date: str = "date", name: str = "anchored_vwap") -> DataFrame:
    """Rows (with a symbol) and the VWAP of the symbol's bars from each row's anchor to its date, both included.

    Sums over a range of dates are a difference of two running sums: those before the anchor, and those up to the date. Rows and bars are
    brought together by symbol once; rows go among the bars first at the day before their anchor, then at their date. No row meets the bars
    between, and none is joined. What is already dealt by symbol, such as the result of another lookup, stays where it is. Bars are
    unique, so a symbol has one a day; all rows of a symbol are in one task. Null without a bar in the range, with an anchor after the date,
    or with a missing symbol or date; a missing anchor reaches back to the first bar.
    """
    # what is before a time is what is up to the microsecond before it
    days = {"_at": f"cast(cast({anchor} as timestamp) - interval 1 microsecond as date)", "_to": f"cast(cast({date} as timestamp) as date)"}
    own = F.struct(*[f"`{c}`" for c in rows.columns if c != "symbol"]).alias("_own")
    asked = add(rows, days).select(F.col("symbol").alias("_symbol"), *days, own)
    told = bars.selectExpr("symbol as _symbol", "date", f"{TYPICAL} as _typical", "volume").repartition("_symbol")
    found = add(told, dict.fromkeys(days, "date")).drop("date").unionByName(asked.repartition("_symbol"), allowMissingColumns=True)
    # rows of one day are peers in the frames, so a day sees the bar of its own date
    sums = {"last": "max(if(_own is null, _at, null))"} | vwap_sums("_typical")
    found = add(found, {f"_{n}": f"{sql} over (partition by _symbol order by _at)" for n, sql in sums.items()})
    # a row keeps the sums before its anchor, a bar its own for the rows whose date comes next
    sofar = f"struct({', '.join(f'_{n}' for n in sums)})"
    found = found.selectExpr("_symbol", *days, "_own", f"if(_own is null, null, {sofar}) as _before", f"if(_own is null, {sofar}, null) as _bar")
    found = add(found, {"_upto": "last(_bar, true) over (partition by _symbol order by _to)"})
    inside = "_symbol is not null and _upto._last is not null and (_at is null or _upto._last > _at)"
    value = vwap(*[f"(_upto._{n} - if(_before._last is null, 0, _before._{n}))" for n in VWAP_SUMS])
    symbol = f"cast(_symbol as {asked.schema['_symbol'].dataType.simpleString()}) as symbol"
    kept = [symbol if c == "symbol" else f"_own.`{c}` as `{c}`" for c in rows.columns]
    return found.where("_own is not null").selectExpr(*kept, f"case when {inside} then {value} end as {name}")


def with_distance_since(rows: DataFrame, bars: DataFrame, anchor: str, name: str = "avwap_distance_percent") -> DataFrame:
    """Rows (with symbol, date and close) and the distance of their close from the VWAP since their anchor, in percent."""
    found = avwap_since(rows, bars, anchor, name="_since")
    return add(found, {name: percent_from("_since")}).drop("_since")
