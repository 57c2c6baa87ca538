"""Adding columns from SQL text.

Operators that add many columns state them as SQL and add them in one projection:
one analysis of the plan instead of one per column, and frames in calendar days over
a DATE, which only SQL text can express.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


def add(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The table with further columns, given as name -> SQL expression."""
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()]) if columns else df


# Frames by symbol in bar order.
BY_SYMBOL = "partition by symbol order by date"


@dataclass(frozen=True)
class WindowFeature:
    """Columns computed from a symbol's bars, as SQL.

    `running` are narrow window expressions that `windows` may look back on; `columns`
    is what remains in the end. Features added together share their window passes,
    and the wide columns only exist in the last one.
    """

    windows: Mapping[str, str]
    columns: Mapping[str, str] = field(default_factory=dict)
    running: Mapping[str, str] = field(default_factory=dict)
    scratch: tuple[str, ...] = ()


def merged(features: Iterable[WindowFeature], part: str) -> dict[str, str]:
    return {name: sql for f in features for name, sql in getattr(f, part).items()}


def add_features(bars: DataFrame, features: Iterable[WindowFeature]) -> DataFrame:
    features = list(features)
    table = bars
    for part in ("running", "windows", "columns"):
        table = add(table, merged(features, part))
    return drop_scratch(table, features)


def drop_scratch(table: DataFrame, features: Iterable[WindowFeature]) -> DataFrame:
    return table.drop(*[name for f in features for name in f.scratch])
