"""Scaling, logarithms and conversions of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, FractionalType, IntegralType, NumericType

from tesserae.plans.data import Direction, ExprData

PRECISION = {"single": "float", "double": "double"}


def _as(precision: str) -> str:
    if precision not in PRECISION:
        raise ValueError(f"precision is one of {', '.join(PRECISION)}")
    return PRECISION[precision]


def needs_float(kind: DataType) -> bool:
    """Whether entries of a type become floats; an error for what is no number."""
    if isinstance(kind, BooleanType) or not isinstance(kind, NumericType):
        raise TypeError(f"entries of {kind.simpleString()} are no numbers")
    return isinstance(kind, IntegralType) or not isinstance(kind, FractionalType)


def convert_to_float(x: DataFrame, precision: str = "double") -> DataFrame:
    """Entries as floats; which ones are stored doesn't change."""
    needs_float(x.schema["value"].dataType)
    return x.withColumn("value", F.col("value").cast(_as(precision)))


def convert_array(values: Column, precision: str = "double") -> Column:
    """An array, or an array of arrays, as floats; a value that is no number is an error."""
    return F.transform(values, lambda v: v.cast(_as(precision)))


def normalize_expression(data: ExprData, target: float, direction: Direction = Direction.ROW, precision: str = "double") -> ExprData:
    """Entries times target over the sum of their row or column; those of a sum of zero stay."""
    sums = data.x.groupBy(direction.key).agg(F.sum(F.col("value").cast("double")).alias("__sum"))
    value = F.col("value").cast("double")
    scaled = F.when(F.col("__sum") != 0, value * F.lit(float(target)) / F.col("__sum")).otherwise(value)
    return data.with_(x=data.x.join(sums, direction.key).select("obs_id", "var_id", scaled.cast(_as(precision)).alias("value")))


def log1p_expression(data: ExprData, precision: str = "double") -> ExprData:
    """ln(1 + v) of entries; a zero stays a zero."""
    return data.with_(x=data.x.select("obs_id", "var_id", F.log1p(F.col("value").cast("double")).cast(_as(precision)).alias("value")))


def frame_from_groups(rows: DataFrame, place: str, group: str, value: str, groups: list[str]) -> DataFrame:
    """A long table as a wide one: a row for each place and a column for each group, in the order given."""
    return rows.groupBy(place).pivot(group, groups).agg(F.first(value))
