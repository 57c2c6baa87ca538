"""Outcome tables as CSV files: writing, reading, older column names, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscan.functions.measures import ABSENT
from gapscan.schema import LEGACY_NAMES, OUTCOME_COLUMNS


def publish(outcomes: DataFrame) -> DataFrame:
    """Outcomes rounded to two decimals, the form that is written and reported on."""
    return outcomes.select(
        *[F.round(f.name, 2).alias(f.name, metadata=f.metadata) if f.dataType.simpleString() == "double" else f.name
          for f in outcomes.schema.fields]
    )


def write_outcomes(outcomes: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header; booleans as True and False, missing values empty."""

    def as_text(name: str, kind: str) -> Column:
        if kind == "boolean":
            return F.initcap(F.col(name).cast("string")).alias(name)
        return F.col(name)

    published = publish(outcomes).select(*[as_text(n, k) for n, k in OUTCOME_COLUMNS.items()])
    published.write.mode(mode).option("header", True).csv(path)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes from CSV by column name; text that does not parse becomes null.

    An empty file gives an empty table. Columns are typed without an inference scan.
    """
    text = spark.read.option("header", True).csv(path)
    return normalize_outcomes(text, direction=direction_of(path))


def direction_of(path: str) -> str:
    """Trade direction as the file's own name tells it, whatever folders it lies in."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return "long" if "long" in name else "short" if "short" in name else "unknown"


def normalize_outcomes(df: DataFrame, direction: str | None = None) -> DataFrame:
    """The outcome columns in order, from today's or older names; absent ones are null and marked as unknown.

    A direction column is kept when there is one, else filled with the given direction.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def column(name: str, kind: str) -> Column:
        source = name if name in kinds else LEGACY_NAMES.get(name)
        if source not in kinds:
            return F.lit(None).cast(kind).alias(name, metadata=ABSENT)
        if kind == "date":
            value = F.try_to_timestamp(source).cast("date") if kinds[source] == "string" else F.col(source).cast("date")
        elif kind == "int" and kinds[source] == "string":
            # Counts may be written with a fraction, as in "3.0".
            value = F.col(source).try_cast("double").try_cast("int")
        elif kind == "double":
            value = F.nullif(F.col(source).try_cast("double"), F.lit(float("nan")))
        else:
            value = F.col(source).try_cast(kind)
        return value.alias(name)

    columns = [column(name, kind) for name, kind in OUTCOME_COLUMNS.items()]
    given = F.lower("direction") if "direction" in kinds else F.lit(direction).cast("string")
    return df.select(*columns, given.alias("direction"))
