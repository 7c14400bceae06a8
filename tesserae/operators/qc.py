"""Quality-control metrics of observations and variables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tesserae.plans.data import Direction, ExprData

#: How the names of mitochondrial genes begin.
MITO = ("MT-", "mt-")


def _source(data: ExprData, layer: str | None, use_raw: bool) -> ExprData:
    if layer is not None:
        return data.with_(x=data.layers[layer])
    if use_raw:
        raise ValueError("use_raw needs a layer")
    return data


def describe_obs(data: ExprData, expr_type: str, var_type: str, qc_vars: Sequence[str], percent_top: Sequence[int], log1p: bool) -> DataFrame:
    """A row for each observation. Entries are ordered within their observation, which has at most as many as there are
    variables, and everything is summed by one aggregate over the same partitioning: one shuffle of the entries."""
    kinds = dict(data.var.dtypes)
    for name in qc_vars:
        if not isinstance(data.var.schema[name].dataType if name in kinds else None, BooleanType):
            raise ValueError(f"{name} is no boolean column of variables")
    x = data.x.where("value <> 0")
    if qc_vars:
        flags = data.var.select("var_id", *(F.coalesce(F.col(f"`{g}`"), F.lit(False)).alias(f"g{i}") for i, g in enumerate(qc_vars)))
        x = x.join(flags, "var_id", "left")
    parts = [F.sum(F.when(F.col(f"g{i}"), F.col("value")).otherwise(0.0)).alias(f"t{i}") for i in range(len(qc_vars))]
    tops = list(dict.fromkeys(percent_top))
    if tops:
        n_vars = data.length(Direction.COLUMN)
        if max(tops) > n_vars:
            raise ValueError(f"{max(tops)} is more than the {n_vars} variables there are")
        own = Window.partitionBy("obs_id")
        order, stored = F.row_number().over(own.orderBy(F.desc("value"), "var_id")), F.count(F.lit(1)).over(own)
        x = x.withColumn("place", F.when(F.col("value") > 0, order).otherwise(order + n_vars - stored))
        parts += [F.sum(F.when(F.col("place") <= n, F.col("value")).otherwise(0.0)).alias(f"s{n}") for n in tops]
    sums = x.groupBy("obs_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("t"), *parts)
    rows = data.obs.select("obs_id").join(sums, "obs_id", "left").select("obs_id", *(F.coalesce(c, F.lit(0) if c == "n" else F.lit(0.0)).alias(c) for c in sums.columns if c != "obs_id"))
    out = [F.col("n").alias(f"n_{var_type}_by_{expr_type}")]
    if log1p:
        out.append(F.log1p("n").alias(f"log1p_n_{var_type}_by_{expr_type}"))
    out.append(F.col("t").alias(f"total_{expr_type}"))
    if log1p:
        out.append(F.log1p("t").alias(f"log1p_total_{expr_type}"))
    out += [F.when(F.col("t") > 0, F.col(f"s{n}") / F.col("t") * 100.0).otherwise(0.0).alias(f"pct_{expr_type}_in_top_{n}_{var_type}") for n in tops]
    for i, g in enumerate(qc_vars):
        out.append(F.col(f"t{i}").alias(f"total_{expr_type}_{g}"))
        if log1p:
            out.append(F.log1p(f"t{i}").alias(f"log1p_total_{expr_type}_{g}"))
        out.append(F.when(F.col("t") > 0, F.col(f"t{i}") / F.col("t") * 100.0).otherwise(0.0).alias(f"pct_{expr_type}_{g}"))
    return rows.select("obs_id", *out)


def describe_var(data: ExprData, expr_type: str, log1p: bool) -> DataFrame:
    """A row for each variable; means and dropouts are over all observations."""
    n_obs = float(data.length(Direction.ROW))
    sums = data.x.groupBy("var_id").agg(F.count_if(F.col("value") != 0).alias("n"), F.sum("value").alias("t"))
    rows = data.var.select("var_id").join(sums, "var_id", "left").select("var_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0.0)).alias("t"))
    mean = F.col("t") / F.lit(n_obs) if n_obs else F.lit(None).cast("double")
    out = [F.col("n").alias(f"n_cells_by_{expr_type}"), mean.alias(f"mean_{expr_type}")]
    if log1p:
        out.append(F.log1p(mean).alias(f"log1p_mean_{expr_type}"))
    out.append(((1.0 - F.col("n") / F.lit(n_obs)) * 100.0 if n_obs else F.lit(None).cast("double")).alias(f"pct_dropout_by_{expr_type}"))
    out.append(F.col("t").alias(f"total_{expr_type}"))
    if log1p:
        out.append(F.log1p("t").alias(f"log1p_total_{expr_type}"))
    return rows.select("var_id", *out)


def calculate_qc_metrics(
    data: ExprData,
    expr_type: str = "counts",
    var_type: str = "genes",
    qc_vars: Sequence[str] = (),
    percent_top: Sequence[int] = (50, 100, 200, 500),
    layer: str | None = None,
    use_raw: bool = False,
    inplace: bool = False,
    log1p: bool = False,
) -> ExprData | tuple[DataFrame, DataFrame]:
    """Metrics as two tables, or with inplace a container that has them as columns of its metadata.

    A layer takes the matrix's place. A number of percent_top above the number of variables is an error."""
    source = _source(data, layer, use_raw)
    obs, var = describe_obs(source, expr_type, var_type, qc_vars, percent_top, log1p), describe_var(source, expr_type, log1p)
    if not inplace:
        return obs, var
    return data.annotate(Direction.ROW, obs).annotate(Direction.COLUMN, var)


def qc_metrics(data: ExprData, percent_top: Sequence[int] = (50, 100, 200, 500)) -> ExprData:
    """Metrics in place with the mitochondrial mask, which is made from the names of variables."""
    named = data.var.withColumn("mito", F.coalesce(F.startswith("var_name", F.lit(MITO[0])) | F.startswith("var_name", F.lit(MITO[1])), F.lit(False)))
    return calculate_qc_metrics(data.with_(var=named), qc_vars=["mito"], percent_top=percent_top, inplace=True, log1p=True)
