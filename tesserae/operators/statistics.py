"""Statistics of each observation or variable. Entries that aren't stored are zeros and count everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.data import Direction, ExprData


def masked(data: ExprData, direction: Direction, mask: Column | None) -> DataFrame:
    """Entries whose other axis passes mask, a condition on that axis's metadata; null is false."""
    if mask is None:
        return data.x
    other = direction.other
    return data.x.join(data.meta(other).where(F.coalesce(mask, F.lit(False))).select(other.key), other.key, "left_semi")


def _filled(data: ExprData, direction: Direction, found: DataFrame, columns: Sequence[Column]) -> DataFrame:
    return data.meta(direction).select(direction.key).join(found, direction.key, "left").select(direction.key, *columns)


def nonzero(data: ExprData, direction: Direction, mask: Column | None = None) -> DataFrame:
    """n: entries that aren't zero, over the variables or observations that pass mask."""
    found = masked(data, direction, mask).groupBy(direction.key).agg(F.count_if(F.col("value") != 0).alias("n"))
    return _filled(data, direction, found, [F.coalesce("n", F.lit(0)).alias("n")])


def total(data: ExprData, direction: Direction, mask: Column | None = None) -> DataFrame:
    """total: the sum of entries, over the variables or observations that pass mask."""
    found = masked(data, direction, mask).groupBy(direction.key).agg(F.sum("value").alias("total"))
    return _filled(data, direction, found, [F.coalesce("total", F.lit(0.0)).alias("total")])


def count_and_total(data: ExprData, direction: Direction, mask: Column | None = None) -> DataFrame:
    """n and total by one aggregate."""
    found = masked(data, direction, mask).groupBy(direction.key).agg(F.count_if(F.col("value") != 0).alias("n"), F.sum("value").alias("total"))
    return _filled(data, direction, found, [F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total")])


def variance_of(n: int | Column, sums: Column, squares: Column) -> Column:
    """Sample variance from sums over an axis of n; null below two."""
    length = n if isinstance(n, Column) else F.lit(float(n))
    return F.when(length > 1, F.greatest((squares - sums * sums / length) / (length - 1.0), F.lit(0.0)))


def variance(data: ExprData, direction: Direction) -> DataFrame:
    """variance: the sample variance, zeros included; null where the other axis has fewer than two."""
    n = data.length(direction.other)
    found = data.x.groupBy(direction.key).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    sums, squares = (F.coalesce(c, F.lit(0.0)) for c in ("s", "q"))
    return _filled(data, direction, found, [variance_of(n, sums, squares).alias("variance")])


def min_max(data: ExprData, direction: Direction) -> DataFrame:
    """min and max, where an entry that isn't stored is a zero."""
    n = data.length(direction.other)
    found = data.x.groupBy(direction.key).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("stored"))
    full = F.coalesce("stored", F.lit(0)) >= n
    low, high = (F.when(full, F.col(c)).otherwise(F.coalesce(f(F.col(c), F.lit(0.0)), F.lit(0.0))) for f, c in ((F.least, "low"), (F.greatest, "high")))
    return _filled(data, direction, found, [low.alias("min"), high.alias("max")])


def _ranked(data: ExprData, direction: Direction, n: int) -> DataFrame:
    """The n largest stored entries of each, with rn and in place their rank among all entries, zeros included."""
    length = data.length(direction.other)
    if n > length:
        raise ValueError(f"{n} is more than the {length} entries there are")
    order = Window.partitionBy(direction.key).orderBy(F.desc("value"), direction.other.key)
    top = data.x.where("value <> 0").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    stored = data.x.where("value <> 0").groupBy(direction.key).agg(F.count(F.lit(1)).alias("stored"), F.sum("value").alias("all"))
    place = F.when(F.col("value") > 0, F.col("rn")).otherwise(F.col("rn") + F.lit(length) - F.col("stored"))
    return top.join(stored, direction.key).withColumn("place", place.cast("long"))


def n_top(data: ExprData, direction: Direction, n: int) -> DataFrame:
    """top: the n largest entries in falling order, zeros included."""
    found = _ranked(data, direction, n).where(F.col("place") <= n).groupBy(direction.key).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("at"))
    each = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0.0))) if n else F.array().cast("array<double>")
    return _filled(data, direction, found, [each.alias("top")])


def top_segment_proportions(data: ExprData, direction: Direction, ns: Sequence[int]) -> DataFrame:
    """top_<n>: the share of the n largest entries in the sum of all; 0 where that isn't positive. Each n is computed once."""
    wanted = list(dict.fromkeys(ns))
    if not wanted:
        return data.meta(direction).select(direction.key)
    ranked = _ranked(data, direction, max(wanted))
    sums = [F.sum(F.when(F.col("place") <= n, F.col("value")).otherwise(0.0)).alias(f"s{n}") for n in wanted]
    found = ranked.groupBy(direction.key).agg(F.first("all").alias("all"), *sums)
    shares = [F.when(F.col("all") > 0, F.col(f"s{n}") / F.col("all")).otherwise(0.0).alias(f"top_{n}") for n in wanted]
    return _filled(data, direction, found, shares)


#: Whole and chunked forms are one operator: Spark aggregates in parts by itself.
nonzero_whole = nonzero_chunk = nonzero_whole_masked = nonzero
sum_whole = sum_chunk = sum_whole_masked = total
variance_whole = variance_chunk = variance
min_max_whole = min_max_chunk = min_max
n_top_whole = n_top
