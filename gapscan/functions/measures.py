"""Aggregate expressions of the reports: rates, exact sums, profit factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Metadata of a column that its file does not have: it is unknown, not a miss on every row.
ABSENT = {"absent": True}


def known(outcomes: DataFrame, name: str) -> bool:
    return not outcomes.schema[name].metadata.get("absent", False)


def if_known(outcomes: DataFrame, name: str, measure: Column) -> Column:
    """The measure, or null if the table does not have its column."""
    return measure if known(outcomes, name) else F.lit(None).cast("double")


def flag(condition: str) -> Column:
    """A boolean column as 0/1, with unknown counted as 0."""
    return F.coalesce(F.col(condition).cast("int"), F.lit(0))


def rate(condition: str) -> Column:
    """Percentage of rows where the condition holds; unknown counts as a miss."""
    return F.avg(flag(condition)) * 100


def exact_sum(value: Column, scale: int = 8) -> Column:
    """Sum of doubles that is the same whatever order the tasks add in."""
    return F.sum(value.cast(f"decimal(26,{scale})")).cast("double")


def exact_mean(value: Column, scale: int = 8) -> Column:
    return F.when(F.count(value) > 0, exact_sum(value, scale) / F.count(value))


def clipped(value: Column, low: float, high: float) -> Column:
    """Value held within [low, high]; null stays null (greatest and least skip nulls)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def retrace_fraction(percent: str) -> Column:
    return clipped(F.col(percent) / 100, 0.0, 1.0)


def ratio_or_infinity(profit: Column, loss: Column) -> Column:
    """profit / loss; infinite when there is only profit, null when there is neither."""
    return F.when(loss > 0, profit / loss).when(profit > 0, F.lit(float("inf")))


def fraction_profit_factor(percent: str) -> Column:
    """Sum of retrace fractions over sum of what was missing to a full retrace."""
    fraction = F.coalesce(retrace_fraction(percent), F.lit(0.0))
    return ratio_or_infinity(exact_sum(fraction), exact_sum(1 - fraction))


def win_profit_factor(condition: str) -> Column:
    """Wins over losses."""
    wins = F.sum(flag(condition))
    return ratio_or_infinity(wins, F.count(F.lit(1)) - wins)
