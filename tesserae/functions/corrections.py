"""Corrections of p-values for multiple testing, as windows over each group of tests or, where a group is too long for a task, split.

Equal p-values have equal adjusted ones, so a group is its distinct values with their numbers, pre-aggregated in each task. Split, these
are cut into bands of nearly equal values: running counts and extremes of the bands, of which there are a few thousand at most, are
carried into each band, and only within a band values are put in order. The tests are then computed twice, once for their values and once
for the result.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Correction(Enum):
    BONFERRONI = "bonferroni"
    BENJAMINI_HOCHBERG = "benjamini_hochberg"
    BENJAMINI_YEKUTIELI = "benjamini_yekutieli"
    HOLM = "holm"
    HOCHBERG = "hochberg"
    STOREY = "storey"


#: Storey's tuning value.
LAMBDA = 0.5
#: Bands from a value to its double; bands of zero and of what is no number.
BANDS_PER_DOUBLING, ZERO, NONE = 64.0, -100_000, 100_000
#: Fixed value: the limit of harmonic numbers less the logarithm. Up to so many terms they are added up.
EULER, TERMS = 0.5772156649015329, 64


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: added up for few terms, else by the first terms of its expansion, which miss less than 1e-14 there."""
    few = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(TERMS)).cast("int")), F.lit(0.0), lambda total, i: total + 1.0 / i)
    square = m * m
    return F.when(m <= TERMS, few).otherwise(F.log(m) + EULER + 1.0 / (2.0 * m) - 1.0 / (12.0 * square) + 1.0 / (120.0 * square * square))


def _adjusted(values: DataFrame, method: Correction, lam: float) -> DataFrame:
    """group, p and adjusted of values (group, p, n, not null)."""
    p, falling = F.col("p"), method is not Correction.HOLM
    band = F.when(F.isnan(p), NONE).when(p <= 0, ZERO).otherwise(F.floor(F.log2(p) * BANDS_PER_DOUBLING))
    values = values.withColumn("band", band.cast("int"))
    bands = values.groupBy("group", "band").agg(F.sum("n").alias("held"), F.sum(F.when(p > lam, F.col("n")).otherwise(0)).alias("above"))
    family = Window.partitionBy("group")
    before = Window.unboundedPreceding, -1
    ahead = F.coalesce(F.sum("held").over(family.orderBy("band").rowsBetween(*before)), F.lit(0))
    bands = bands.select("group", "band", F.sum("held").over(family).cast("double").alias("m"), F.sum("above").over(family).cast("double").alias("above"), ahead.alias("ahead"))
    own = Window.partitionBy("group", "band")
    upto = F.col("ahead") + F.sum("n").over(own.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = values.join(bands, ["group", "band"]).withColumn("upto", upto.cast("double"))
    m, i, n = F.col("m"), F.col("upto"), F.col("n")
    # Of equal values the last one is the least of what counts from the end, and the first one the most of what counts from the start.
    each = {Correction.BONFERRONI: m * p, Correction.HOLM: (m - i + n) * p, Correction.HOCHBERG: (m - i + 1.0) * p}.get(method, m * p / i)
    if method is Correction.BONFERRONI:
        return rows.select("group", "p", F.least(F.lit(1.0), each).alias("adjusted"))
    most, extreme = (F.min, F.least) if falling else (F.max, F.greatest)
    rows = rows.withColumn("each", each)
    along = F.col("band").desc() if falling else F.col("band").asc()
    carried = rows.groupBy("group", "band").agg(most("each").alias("each"))
    carried = carried.select("group", "band", most("each").over(family.orderBy(along).rowsBetween(*before)).alias("carried"))
    inside = most("each").over(own.orderBy(p.desc() if falling else p.asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("inside", inside).join(carried, ["group", "band"])
    value = extreme("inside", F.coalesce("carried", "inside"))
    if method is Correction.BENJAMINI_YEKUTIELI:
        value = value * harmonic(m)
    elif method is Correction.STOREY:
        value = value * F.least(F.lit(1.0), F.col("above") / (m * (1.0 - lam)))
    return found.select("group", "p", F.least(F.lit(1.0), value).alias("adjusted"))


def _split(tests: DataFrame, group: str, p: str, method: Correction, name: str, lam: float) -> DataFrame:
    # A null group is one too: structs of null are equal.
    values = tests.where(F.col(p).isNotNull()).groupBy(F.struct(F.col(group).alias("group")).alias("group"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    found = _adjusted(values, method, lam).toDF("__group", "__p", name)
    tests = tests.drop(name)
    both = tests.join(found, (F.struct(tests[group].alias("group")) == found["__group"]) & (tests[p] == found["__p"]), "left")
    return both.drop("__group", "__p")


def apply_correction(tests: DataFrame, group: str, p: str, tie: str, method: Correction, name: str = "pval_adj", lam: float = LAMBDA, split: bool = False) -> DataFrame:
    """tests with a column of adjusted p-values. tie orders equal p-values, which doesn't change the result; a null p stays
    null and isn't counted. m is the number of a group's tests. With split, no task holds a group."""
    if split:
        return _split(tests, group, p, method, name, lam)
    own = Window.partitionBy(group, F.col(p).isNull())
    rising = own.orderBy(F.col(p).asc(), tie)
    m, i, value = F.count(F.lit(1)).over(own).cast("double"), F.row_number().over(rising).cast("double"), F.col(p)

    def running(f: object, of: Column, rank: Column) -> Column:
        """f over the tests up to a rank; rank falls or rises."""
        return f(of).over(own.orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))

    rows = tests.withColumns({"__m": m, "__i": i})
    m, i = F.col("__m"), F.col("__i")
    if method is Correction.BONFERRONI:
        found = m * value
    elif method is Correction.HOLM:
        found = running(F.max, (m - i + 1) * value, i.asc())
    elif method is Correction.HOCHBERG:
        found = running(F.min, (m - i + 1) * value, i.desc())
    else:
        found = running(F.min, m * value / i, i.desc())
        if method is Correction.BENJAMINI_YEKUTIELI:
            found = found * F.sum(1.0 / i).over(own)
        elif method is Correction.STOREY:
            found = found * F.least(F.lit(1.0), F.sum(F.when(value > lam, 1.0).otherwise(0.0)).over(own) / (m * (1.0 - lam)))
    return rows.withColumn(name, F.when(value.isNotNull(), F.least(F.lit(1.0), found))).drop("__m", "__i")
