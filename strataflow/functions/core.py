"""Helpers every expression uses: missing values, clipping, safe casts, dates, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FT_TO_M = 0.3048


def col(c: str | Column | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def clip(x: str | Column, low: float | Column, high: float | Column) -> Column:
    """x held in [low, high]; missing stays missing."""
    x, low, high = col(x), col(low), col(high)
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column: missing has one form inside the engine."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def nodata_to_null(x: str | Column, nodata: float) -> Column:
    x = col(x)
    return F.when(x != F.lit(nodata), x)


def month_of(ts: str | Column) -> Column:
    """First day of the month as DATE."""
    return F.trunc(F.to_date(col(ts)), "month")


def optional(df: DataFrame, **columns: str) -> DataFrame:
    """df with the named columns of the given types; those it lacks are NULL."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def feet_to_metres(x: str | Column) -> Column:
    return col(x) * FT_TO_M


def flag(x: str | Column) -> Column:
    """A boolean, missing as false."""
    return F.coalesce(col(x), F.lit(False))
