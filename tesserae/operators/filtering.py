"""Marks of observations and variables that pass bounds; nothing is removed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.plans.data import Direction, ExprData


def combine_filters(*masks: Column) -> Column:
    """All of masks; true for none."""
    return reduce(lambda a, b: a & b, masks, F.lit(True))


def _mark(data: ExprData, direction: Direction, counts: tuple, sums: tuple, fractions: tuple) -> DataFrame:
    """Only the aggregates that a bound needs are computed, and no scan at all without bounds."""
    need_n, need_sum = (any(b is not None for b in bounds) for bounds in ((*counts, *fractions), sums))
    aggs = [F.count_if(F.col("value") != 0).alias("n")] * need_n + [F.sum("value").alias("t")] * need_sum
    meta = data.meta(direction)
    if not aggs:
        return meta.select(direction.key, F.lit(True).alias("keep"))
    found = data.x.groupBy(direction.key).agg(*aggs)
    rows = meta.select(direction.key).join(found, direction.key, "left")
    n, t = F.coalesce("n", F.lit(0)) if need_n else None, F.coalesce("t", F.lit(0.0)) if need_sum else None
    share = n / F.lit(float(data.length(direction.other))) if need_n and any(b is not None for b in fractions) else None
    bounds = []
    for value, (low, high) in ((n, counts), (t, sums), (share, fractions)):
        bounds += [value >= F.lit(float(low))] if low is not None else []
        bounds += [value <= F.lit(float(high))] if high is not None else []
    return rows.select(direction.key, combine_filters(*bounds).alias("keep"))


def mark_filter_cells(
    data: ExprData,
    min_genes: int | None = None,
    max_genes: int | None = None,
    min_counts: float | None = None,
    max_counts: float | None = None,
    min_fraction: float | None = None,
    max_fraction: float | None = None,
) -> DataFrame:
    """obs_id and keep: whether variables, their sum and their share are within the inclusive bounds given."""
    return _mark(data, Direction.ROW, (min_genes, max_genes), (min_counts, max_counts), (min_fraction, max_fraction))


def mark_filter_genes(
    data: ExprData,
    min_cells: int | None = None,
    max_cells: int | None = None,
    min_counts: float | None = None,
    max_counts: float | None = None,
    min_fraction: float | None = None,
    max_fraction: float | None = None,
) -> DataFrame:
    """var_id and keep: whether observations, their sum and their share are within the inclusive bounds given."""
    return _mark(data, Direction.COLUMN, (min_cells, max_cells), (min_counts, max_counts), (min_fraction, max_fraction))
