"""Variances, extremes and largest entries of an axis over a stream of entries, for output mode update.

After each batch the ids that it had entries of are given with the statistic of all entries so far, where an entry that hasn't
come is a zero; so after the last batch they equal those of `operators.statistics` over the whole table. Each entry comes once.
State has a row for each id: sums and moments, which Spark merges, or the n largest entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.plans.data import Direction


def running_moments(entries: DataFrame, direction: Direction, length: int) -> DataFrame:
    """n, total, variance, min and max of each observation or variable so far, over an axis of length.

    The variance comes from the mean and the central moment of the entries, to which the zeros are merged; it is null below a
    length of two. Null and NaN values are zeros. An id with more entries than length fails."""
    value = F.nanvl("value", F.lit(0.0))
    found = entries.groupBy(direction.key).agg(
        F.count_if(value != 0).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.count(value).alias("stored"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("spread"), F.min(value).alias("low"), F.max(value).alias("high"),
    )
    stored, zeros = F.col("stored"), F.lit(length) - F.col("stored")
    moment = stored * F.col("spread") + F.col("mean") * F.col("mean") * stored * zeros / F.lit(float(max(1, length)))
    low, high = (F.when(zeros == 0, F.col(c)).otherwise(F.coalesce(f(F.col(c), F.lit(0.0)), F.lit(0.0))) for f, c in ((F.least, "low"), (F.greatest, "high")))
    variance = F.when(F.lit(length > 1), moment / F.lit(float(max(1, length - 1))))
    checked = F.when(zeros < 0, F.raise_error(F.lit(f"more than {length} entries of one id"))).otherwise(F.col("n"))
    return found.select(direction.key, checked.alias("n"), "total", variance.alias("variance"), low.alias("min"), high.alias("max"))


def running_n_top(entries: DataFrame, direction: Direction, length: int, n: int) -> DataFrame:
    """top: the n largest entries of each observation or variable so far in falling order, zeros included.

    State holds the n largest of an id's entries other than zero, and how many there were."""
    if n > length:
        raise ValueError(f"{n} is more than the {length} entries there are")
    key = direction.key

    def largest(values: np.ndarray) -> np.ndarray:
        return np.sort(values)[::-1][:n]

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored, top = state.get if state.exists else (0, [])
        top = np.array(top, dtype=float)
        for part in parts:
            values = part["value"].to_numpy(dtype=float)
            values = values[(values != 0) & ~np.isnan(values)]
            stored, top = stored + len(values), largest(np.concatenate([top, values]))
        if stored > length:
            raise ValueError(f"more than {length} entries of {key} {name[0]}")
        state.update((stored, top.tolist()))
        yield pd.DataFrame({key: [name[0]], "top": [largest(np.concatenate([top, np.zeros(min(n, length - stored))])).tolist()]})

    kind = entries.schema[key].dataType.simpleString()
    grouped = entries.select(key, F.col("value").cast("double").alias("value")).groupBy(key)
    return grouped.applyInPandasWithState(run, f"{key} {kind}, top array<double>", "stored long, top array<double>", "update", GroupStateTimeout.NoTimeout)
