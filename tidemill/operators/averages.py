"""Filtered group-by averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.strings import java_trim

MISSING = -99.0


def valid_temperature(text: Column) -> Column:
    """The reading as a double; null if it is no number or the missing mark. NaN and infinities are valid."""
    value = java_trim(text).try_cast("double")
    return F.when(value != MISSING, value)


def average(df: DataFrame, keys: list[str], value: str, name: str = "average", digits: int | None = None) -> DataFrame:
    """Mean of the non-null values of each key (algebraic, so summed before the shuffle); keys without one give no row."""
    mean = F.avg(value)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg((F.round(mean, digits) if digits is not None else mean).alias(name))


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value)
