"""Highly variable variables: dispersions within bins of the mean, residuals of a smooth trend, or variances by a local regression."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.loess import batches, kept, merged, normalized_variances, places, sums
from tesserae.operators.statistics import variance_of
from tesserae.operators.trend import kernel_trend
from tesserae.plans.data import Direction, ExprData

#: What stands for a mean of zero, and what lies beyond the last bin.
LEAST_MEAN, BEYOND = 1e-12, 1e-10
#: Fixed value: the median deviation of a normal variable, in its standard deviations.
MAD_SCALE = 0.6744897501960817
#: Bands of values from one to its double, and more of them than any double has.
BANDS_PER_DOUBLING, BEYOND_BANDS = 64.0, 100_000


class Flavor(Enum):
    SEURAT = "seurat"
    SVR = "svr"
    CELL_RANGER = "cell_ranger"
    LOESS = "loess"


@dataclass(frozen=True)
class HVGParams:
    """span and batch_key are LOESS's, and other flavors don't look at them; max_dispersion bounds CELL_RANGER only."""

    min_mean: float = 0.0125
    max_mean: float = 3.0
    min_dispersion: float = 0.5
    max_dispersion: float = float("inf")
    n_bins: int = 20
    n_top_genes: int | None = None
    flavor: Flavor = Flavor.SEURAT
    span: float = 0.3
    batch_key: str | None = None


def moments(data: ExprData, parts: DataFrame | None = None) -> DataFrame:
    """var_id, mean and variance over all observations, from entries or from parts (var_id, s, q), sums of some of their values and squares each."""
    n = data.length(Direction.ROW)
    if parts is None:
        parts = data.x.select("var_id", F.col("value").alias("s"), (F.col("value") * F.col("value")).alias("q"))
    found = parts.groupBy("var_id").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    total, squares = (F.coalesce(c, F.lit(0.0)) for c in ("s", "q"))
    mean = total / F.lit(float(n)) if n else F.lit(None).cast("double")
    return data.var.select("var_id").join(found, "var_id", "left").select("var_id", mean.alias("mean"), variance_of(n, total, squares).alias("variance"))


def dispersions(rows: DataFrame) -> DataFrame:
    """var_id, means = ln(mean + 1) and dispersions = ln(variance / mean), null where that isn't positive."""
    guarded = F.when(F.col("mean") <= LEAST_MEAN, LEAST_MEAN).otherwise(F.col("mean"))
    ratio = F.col("variance") / guarded
    return rows.select("var_id", F.log(F.col("mean") + 1.0).alias("means"), F.when(ratio > 0, F.log(ratio)).alias("dispersions"))


def equal_width_bins(rows: DataFrame, n_bins: int) -> DataFrame:
    """rows with bin, of n_bins equal widths over means: a bin holds its left edge, and a mean that is null is in bin 0."""
    low, high = rows.agg(F.min("means"), F.max("means")).first()
    if low is None:
        raise ValueError("no variable has a mean")
    width = (high - low) / n_bins
    edges = F.array(*(F.lit(low + i * width) for i in range(n_bins)), F.lit(high + BEYOND))
    below = F.size(F.filter(edges, lambda e: e <= F.col("means"))) - 1
    return rows.withColumn("bin", F.coalesce(F.greatest(F.lit(0), F.least(below, F.lit(n_bins - 1))), F.lit(0)))


def normalized_dispersions(rows: DataFrame) -> DataFrame:
    """rows with dispersions_norm, the distance from the bin's mean in its deviations; a bin of one measures by its own value."""
    stats = rows.groupBy("bin").agg(F.avg("dispersions").alias("m"), F.stddev_samp("dispersions").alias("sd"))
    center = F.when(F.col("sd").isNull(), 0.0).otherwise(F.col("m"))
    scale = F.coalesce("sd", "m")
    return rows.join(stats, "bin").withColumn("dispersions_norm", F.when(scale != 0, (F.col("dispersions") - center) / scale)).drop("m", "sd")


def normalized_by_batch(rows: DataFrame, n_bins: int, batch: str | None = None) -> DataFrame:
    """rows (means, dispersions, batch) with dispersions_norm within bins of equal width of each batch: 0 where a bin has no deviation, or where there is no batch."""
    label = F.col(batch).cast("string") if batch else F.lit("")
    own = Window.partitionBy("__batch")
    low, high = F.min("means").over(own), F.max("means").over(own)
    width = (high - low) / F.lit(float(n_bins))
    at = F.when((F.col("means") == high) | (width <= 0), n_bins - 1).otherwise(F.least(F.floor((F.col("means") - low) / F.when(width > 0, width)), F.lit(n_bins - 1)))
    placed = rows.withColumn("__batch", label).withColumn("bin", at.cast("int"))
    both = Window.partitionBy("__batch", "bin")
    mean, sd = F.avg("dispersions").over(both), F.stddev_samp("dispersions").over(both)
    norm = F.when(F.col("__batch").isNotNull() & (sd > 0), (F.col("dispersions") - mean) / sd)
    return placed.withColumn("dispersions_norm", F.coalesce(norm, F.lit(0.0))).drop("__batch")


def equal_frequency_bins(rows: DataFrame, n_bins: int) -> DataFrame:
    """rows with bin, of as many variables each in order of means; the first bins have one more. Variables are few, so one task orders them."""
    return rows.withColumn("bin", F.ntile(n_bins).over(Window.partitionBy(F.lit(0)).orderBy("means", "var_id")) - 1)


def order_statistics(rows: DataFrame, key: str, value: str, wanted: str) -> DataFrame:
    """key, place and value: of each key's values in ascending order, those at the places that the array column wanted of any of its rows has, from 1.

    Values are counted in bands of nearly equal ones, pre-aggregated in each task; running counts of a key's bands, of which there
    are a few thousand at most, tell the band of each place, and only the rows of these bands are put in order. No task holds a key's values."""
    level = F.floor(F.log2(F.abs(value)) * BANDS_PER_DOUBLING)
    band = F.when(F.col(value) > 0, level + BEYOND_BANDS).when(F.col(value) < 0, -level - BEYOND_BANDS).otherwise(0)
    each = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("value"), band.alias("band"))
    bands = each.groupBy(key, "band").agg(F.count(F.lit(1)).alias("held"))
    along = Window.partitionBy(key).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("ahead", F.coalesce(F.sum("held").over(along), F.lit(0)))
    places = rows.groupBy(key).agg(F.first(wanted).alias("wanted")).select(key, F.explode(F.array_distinct("wanted")).alias("place"))
    inside = bands.join(places, key).where((F.col("place") > F.col("ahead")) & (F.col("place") <= F.col("ahead") + F.col("held")))
    inside = inside.groupBy(key, "band").agg(F.first("ahead").alias("ahead"), F.collect_set("place").alias("places"))
    counted = each.join(inside, [key, "band"]).groupBy(key, "band", "value").agg(F.count(F.lit(1)).alias("n"), F.first("ahead").alias("ahead"), F.first("places").alias("places"))
    up = F.sum("n").over(Window.partitionBy(key, "band").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = counted.withColumn("upto", F.col("ahead") + up)
    hit = F.filter("places", lambda p: (p <= F.col("upto")) & (p > F.col("upto") - F.col("n")))
    return counted.select(key, "value", F.explode(hit).alias("place")).select(key, "place", "value")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and median: the middle one of each key's values, or the mean of the two; null values don't count, and a key without others has no row."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    half = F.floor((F.col("__n") + 1) / 2).cast("long"), F.floor(F.col("__n") / 2 + 1).cast("long")
    told = rows.join(F.broadcast(counts), key).withColumn("__wanted", F.array(*half))  # a row for each bin
    return order_statistics(told, key, value, "__wanted").groupBy(key).agg(F.avg("value").alias("median"))


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Values at shares of the way from the smallest to the largest, between two neighbours in proportion."""
    n = rows.where(F.col(value).isNotNull()).count()
    if not n:
        raise ValueError("no variable has a mean")
    at = [share * (n - 1) for share in shares]
    wanted = sorted({p for x in at for p in (math.floor(x) + 1, min(math.floor(x) + 2, n))})
    told = rows.select(F.lit(0).alias("__all"), F.col(value), F.array(*(F.lit(p).cast("long") for p in wanted)).alias("__wanted"))
    found = {r["place"]: r["value"] for r in order_statistics(told, "__all", value, "__wanted").collect()}  # two for each share
    low = [math.floor(x) + 1 for x in at]
    return [found[p] + (found[min(p + 1, n)] - found[p]) * (x + 1 - p) for p, x in zip(low, at, strict=True)]


def percentile_bins(rows: DataFrame, n_bins: int) -> DataFrame:
    """rows with bin: means between every (100 / n_bins)-th percentile of all means, from the first on, the ends open. A bin holds its right edge,
    and edges that are equal make one."""
    edges = sorted(set(quantiles(rows, "means", [i / n_bins for i in range(1, n_bins)])))
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("means"))) if edges else F.lit(0)
    return rows.withColumn("bin", F.when(F.col("means").isNotNull(), below))


def percentile(data: ExprData, params: HVGParams) -> DataFrame:
    """var_id, means, dispersions, dispersions_norm, bin and highly_variable, with bins by percentiles of the mean and distances from a bin's median in its median
    deviations (times MAD_SCALE).

    Means and dispersions are those of the values themselves, without logarithms. A mean of zero counts as LEAST_MEAN, and a dispersion of zero as none. A bin
    whose median deviation is zero gives null, which is never chosen. The moments, a row for each variable, are kept, so that entries are read once. With n_top_genes, variables not below the n-th largest distance are chosen, of those within the bounds
    of mean; else those within the bounds of mean and dispersion, ends excluded."""
    rows = kept(moments(data))
    mean = F.when(F.col("mean") == 0, LEAST_MEAN).otherwise(F.col("mean"))
    ratio = F.col("variance") / mean
    rows = rows.select("var_id", mean.alias("means"), F.when(ratio != 0, ratio).alias("dispersions"))
    rows = percentile_bins(rows, params.n_bins)
    center = medians(rows, "bin", "dispersions").withColumnRenamed("median", "center")
    rows = rows.join(F.broadcast(center), "bin", "left").withColumn("off", F.col("dispersions") - F.col("center"))  # a row for each bin
    spread = medians(rows.withColumn("off", F.abs("off")), "bin", "off").select("bin", (F.col("median") / MAD_SCALE).alias("spread"))
    rows = rows.join(F.broadcast(spread), "bin", "left").withColumn("dispersions_norm", F.when(F.col("spread") > 0, F.col("off") / F.col("spread")))
    within = (F.col("means") > params.min_mean) & (F.col("means") < params.max_mean)
    score = F.col("dispersions_norm")
    if params.n_top_genes is not None:
        best = rows.where(within & score.isNotNull()).select(F.round(score, 9).alias("score")).orderBy(F.desc("score")).limit(params.n_top_genes).agg(F.min("score")).first()[0]
        mark = within & (F.round(score, 9) >= best) if best is not None else F.lit(False)
    else:
        mark = within & (score > params.min_dispersion) & (score < params.max_dispersion)
    return rows.select("var_id", "means", "dispersions", "dispersions_norm", F.col("bin").cast("int").alias("bin"), F.coalesce(mark, F.lit(False)).alias("highly_variable"))


def chosen(score: str, n: int) -> Column:
    """A condition for scores not below the n-th largest: ties may exceed n, nulls never pass, and n of 0 chooses none.
    Variables are few, so one task orders them.

    Scores count to nine places: sums that engines add up in another order differ in their last bits, and all bins of two
    variables have the same scores."""
    rank = F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.round(score, 9).desc_nulls_last()))
    return F.col(score).isNotNull() & (rank <= n)


def seurat(data: ExprData, params: HVGParams) -> DataFrame:
    """var_id, means, dispersions, dispersions_norm and highly_variable."""
    rows = normalized_dispersions(equal_width_bins(dispersions(moments(data)), params.n_bins))
    if params.n_top_genes is not None:
        mark = chosen("dispersions_norm", params.n_top_genes)
    else:
        mark = (F.col("means") > params.min_mean) & (F.col("means") < params.max_mean) & (F.coalesce("dispersions_norm", F.lit(0.0)) > params.min_dispersion)
    return rows.select("var_id", "means", "dispersions", "dispersions_norm", F.coalesce(mark, F.lit(False)).alias("highly_variable"))


def standardized(rows: DataFrame, value: str) -> Column:
    """value in deviations (n - 1) from the mean of the finite ones; 0 for others, and for all where there is no deviation."""
    finite = F.coalesce(F.abs(value) < float("inf"), F.lit(False))
    mean, sd = rows.where(finite).agg(F.avg(value), F.stddev_samp(value)).first()
    if not sd:
        return F.lit(0.0)
    return F.when(finite, (F.col(value) - F.lit(mean)) / F.lit(sd)).otherwise(0.0)


def svr(data: ExprData, params: HVGParams) -> DataFrame:
    """var_id, means, variances, residuals, highly_variable, residuals_standardized and mean_variance_trend.

    Variables without a finite ln of mean and variance stay out of the fit and are never chosen by number, for which residuals
    count to nine places, ties to smaller var_id. The fit runs at once; it keeps the moments, a row for each variable."""
    rows = moments(data).persist().withColumns({"x": F.log("mean"), "y": F.log("variance")})
    rows = rows.withColumn("fits", F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False)))
    trend = kernel_trend(rows.where("fits"), "var_id", "x", "y")
    rows = rows.withColumn("trend", F.when(F.col("fits"), trend)).withColumn("residuals", F.col("y") - F.col("trend"))
    rows = rows.withColumn("standardized", standardized(rows, "residuals"))
    mark = (F.col("mean") >= params.min_mean) & (F.col("mean") <= params.max_mean)
    if params.n_top_genes is not None:
        best = rows.where("fits").orderBy(F.round("standardized", 9).desc(), "var_id").limit(params.n_top_genes)
        rows = rows.join(best.select("var_id", F.lit(True).alias("best")), "var_id", "left")
        mark = mark & F.coalesce("best", F.lit(False))
    else:
        mark = mark & (F.coalesce("residuals", F.lit(float("-inf"))) > params.min_dispersion)
    shown = {"means": "mean", "variances": "variance", "residuals": "residuals"}
    return rows.select("var_id", *(F.col(c).alias(n) for n, c in shown.items()), mark.alias("highly_variable"), F.col("standardized").alias("residuals_standardized"), F.col("trend").alias("mean_variance_trend"))


def loess(data: ExprData, params: HVGParams) -> DataFrame:
    """var_id, means, variances, variances_norm, highly_variable_rank, highly_variable_nbatches and highly_variable.

    Each batch (a value of the column batch_key of obs; null takes no part) ranks its variables by their clipped variance in variances of a local
    regression over span of them. With n_top_genes, those are chosen that are first by the median of their ranks among the n_top_genes of
    a batch, then by the number of such batches, then by var_id; else those within the bounds of mean and with a variances_norm above min_dispersion."""
    if params.span <= 0:
        raise ValueError("span must be positive")
    n_batches = batches(data, params.batch_key).select("batch").distinct().count()
    parts = sums(data, params.batch_key)
    found = merged(normalized_variances(data, parts, params.span, params.batch_key), n_batches, params.n_top_genes, params.min_dispersion)
    if params.n_top_genes is not None:
        # Medians are multiples of a half, so that one number has them and then the number of batches.
        order = F.col("highly_variable_rank") * (2.0 * (n_batches + 1)) - F.col("highly_variable_nbatches")
        found = kept(found.withColumn("batch", F.lit("")))
        best = places(found.where("highly_variable_nbatches > 0"), order, "place").select("var_id", "place")
        found = found.join(best, "var_id", "left")
    rows = moments(data, parts).join(found, "var_id", "left")
    norm, many = F.coalesce("variances_norm", F.lit(0.0)), F.coalesce("highly_variable_nbatches", F.lit(0)).cast("long")
    rows = rows.withColumns({"variances_norm": norm, "highly_variable_nbatches": many})
    if params.n_top_genes is not None:
        mark = F.col("place") < params.n_top_genes
    else:
        mark = (F.col("mean") > params.min_mean) & (F.col("mean") < params.max_mean) & (F.col("variances_norm") > params.min_dispersion)
    told = ("variances_norm", "highly_variable_rank", "highly_variable_nbatches")
    return rows.select("var_id", F.col("mean").alias("means"), F.col("variance").alias("variances"), *told, F.coalesce(mark, F.lit(False)).alias("highly_variable"))


def compute_highly_variable_genes(data: ExprData, params: HVGParams | None = None) -> ExprData:
    """The container with the flavor's columns in its variables."""
    params = params or HVGParams()
    found = {Flavor.SEURAT: seurat, Flavor.SVR: svr, Flavor.CELL_RANGER: percentile, Flavor.LOESS: loess}[params.flavor](data, params)
    return data.annotate(Direction.COLUMN, found)
