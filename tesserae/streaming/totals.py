"""Counts and sums of an axis over a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.data import Direction


def running_totals(entries: DataFrame, direction: Direction) -> DataFrame:
    """n and total of each observation or variable so far, for output mode update or complete.

    An entry may come in parts, which add up in total; n counts the parts that aren't zero. State has a row for each id."""
    return entries.groupBy(direction.key).agg(F.count_if(F.col("value") != 0).alias("n"), F.sum("value").alias("total"))
