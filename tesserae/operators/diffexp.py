"""Differential testing of variables between groups of observations.

All groups are tested by one query: sums of each variable and group come from one aggregate with partial sums, and "rest"
is a total less a group's part, so there is no pass for each group and no anti-join. Ranks come from counts of distinct
values, so a variable that all observations have is rows of its values, not of its observations; zeros are one block of ties.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.corrections import Correction, apply_correction
from tesserae.functions.special import exact_rank_p, normal_p, student_p
from tesserae.plans.data import Direction, ExprData


class TestMethod(Enum):
    __test__ = False
    STUDENT = "StudentT"
    WELCH = "WelchT"
    MANN_WHITNEY = "MannWhitney"


REST = "rest"
#: More than eight times the largest binary exponent of a double.
BANDS = 10_000
#: Variables whose ranks one task finds.
VARIABLES = 1 << 11
#: Pairs of observations, one of a group and one of what it is compared with, up to which Mann-Whitney's p is counted out.
EXACT_PAIRS = 400


@dataclass(frozen=True)
class Comparison:
    """Names of groups, their sizes, the groups to test and the reference; None is all other observations."""

    names: list[str]
    sizes: dict[str, int]
    tested: list[str]
    reference: str | None
    n_obs: int = 0
    label: Column = field(default=None, repr=False)


def resolve(data: ExprData, groupby: str, reference: str | None = None, groups: Sequence[str] | None = None) -> Comparison:
    """Labels are compared as text and null ones belong to the rest only; a name that isn't there is an error."""
    if groupby not in data.obs.columns:
        raise ValueError(f"{groupby} is no column of observations")
    label = F.col(groupby).cast("string")
    counts = {r["label"]: r["n"] for r in data.obs.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_obs = sum(counts.values())
    names = sorted(k for k in counts if k is not None)
    unknown = [g for g in groups or () if g not in counts or g is None]
    if unknown:
        raise ValueError(f"no observation has the label {', '.join(map(str, unknown))}")
    if reference is not None and reference != REST and reference not in names:
        raise ValueError(f"no observation has the label {reference}")
    return Comparison(names, {k: counts[k] for k in names}, list(groups) if groups else names, None if reference in (None, REST) else reference, n_obs, label)


def _long(values: dict[str, int], group: Column) -> Column:
    """A number for each name, looked up in one map, however many names there are."""
    if not values:
        return F.lit(None).cast("double")
    named = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(F.lit(float(n)) for n in values.values())))
    return F.try_element_at(named, group)


def group_sums(data: ExprData, who: Comparison) -> DataFrame:
    """group, var_id, and n, s, q (size, sum, sum of squares) of the group and n_ref, s_ref, q_ref of what it is compared with."""
    labels = data.obs.select("obs_id", who.label.alias("group"))
    sums = data.x.join(labels, "obs_id").groupBy("var_id", "group").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    entry = F.map_from_entries(F.collect_list(F.when(F.col("group").isNotNull(), F.struct("group", F.struct("s", "q")))))
    # At most one entry for each label.
    by_var = sums.groupBy("var_id").agg(F.sum("s").alias("all_s"), F.sum("q").alias("all_q"), entry.alias("at"))
    rows = data.var.select("var_id").join(by_var, "var_id", "left").withColumn("group", F.explode(F.array(*map(F.lit, who.tested))) if who.tested else F.explode(F.array().cast("array<string>")))

    def part(name: Column, what: str) -> Column:
        return F.coalesce(F.try_element_at("at", name)[what], F.lit(0.0))

    own = {c: part(F.col("group"), c) for c in ("s", "q")}
    n = _long(who.sizes, F.col("group"))
    if who.reference is None:
        other = {c: F.coalesce(f"all_{c}", F.lit(0.0)) - own[c] for c in ("s", "q")}
        n_ref = F.lit(float(who.n_obs)) - n
    else:
        other = {c: part(F.lit(who.reference), c) for c in ("s", "q")}
        n_ref = F.lit(float(who.sizes[who.reference]))
    return rows.select("group", "var_id", n.alias("n"), own["s"].alias("s"), own["q"].alias("q"), n_ref.alias("n_ref"), other["s"].alias("s_ref"), other["q"].alias("q_ref"))


def _mean(which: str) -> Column:
    return F.when(F.col(f"n{which}") > 0, F.col(f"s{which}") / F.col(f"n{which}")).otherwise(0.0)


def _variance(which: str) -> Column:
    n, s, q = (F.col(f"{c}{which}") for c in "nsq")
    return F.when(n > 1, F.greatest((q - s * s / n) / (n - 1.0), F.lit(0.0)))


def log_fold_change(sums: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """sums with logfoldchange: log2 of means taken back from log1p; 0 where both are 0."""
    mean, other = _mean(""), _mean("_ref")
    ratio = (F.expm1(mean) + pseudocount) / (F.expm1(other) + pseudocount)
    return sums.withColumn("logfoldchange", F.when((mean == 0) & (other == 0), 0.0).otherwise(F.log2(ratio)))


def t_statistics(sums: DataFrame, method: TestMethod) -> DataFrame:
    """sums with t and df. Where both means are 0, or there is no deviation and they are equal, t is 0; without a deviation it is else infinite; null below two observations a side."""
    v, w, n, m = _variance(""), _variance("_ref"), F.col("n"), F.col("n_ref")
    difference = _mean("") - _mean("_ref")
    if method is TestMethod.WELCH:
        error = v / n + w / m
        spread = (v / n) * (v / n) / (n - 1.0) + (w / m) * (w / m) / (m - 1.0)
        df = F.when(spread > 0, error * error / spread).otherwise(n + m - 2.0)
    else:
        pooled = ((n - 1.0) * v + (m - 1.0) * w) / (n + m - 2.0)
        error, df = pooled * (1.0 / n + 1.0 / m), n + m - 2.0
    none = F.when(difference == 0, 0.0).when(difference > 0, float("inf")).otherwise(float("-inf"))
    t = F.when((_mean("") == 0) & (_mean("_ref") == 0), 0.0).when(error > 0, difference / F.sqrt(error)).otherwise(none)
    enough = (n > 1) & (m > 1)
    return sums.withColumns({"t": F.when(enough, t), "df": F.when(enough, df)})


def _tied(data: ExprData, who: Comparison) -> tuple[DataFrame, list[str], Column]:
    """How many observations have each stored value that isn't zero: t in all, and mine in the group or at by label; the columns that tell the
    compared observations apart, and how many these are.

    Entries are dealt to tasks of VARIABLES variables, of which there are more where there are more variables, and stay there until ranks are added up."""
    labels = data.obs.select("obs_id", who.label.alias("label"))
    tasks = max(1, -(-data.length(Direction.COLUMN) // VARIABLES))
    entries = data.x.where("value <> 0").join(labels, "obs_id").select("var_id", "value", "label").repartition(tasks, "var_id")
    counts = entries.groupBy("var_id", "value", "label").agg(F.count(F.lit(1)).alias("c"))
    if who.reference is None:
        each = counts.groupBy("var_id", "value").agg(F.sum("c").alias("t"), F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "c")))).alias("at"))
        return each, ["var_id"], F.lit(float(who.n_obs))
    tested = F.array(*map(F.lit, who.tested)) if who.tested else F.array().cast("array<string>")
    both = counts.withColumn("group", F.explode(F.when(F.col("label") == who.reference, tested).otherwise(F.filter(tested, lambda g: g == F.col("label")))))
    own, ref = F.sum(F.when(F.col("label") == F.col("group"), F.col("c")).otherwise(0)), F.sum(F.when(F.col("label") == who.reference, F.col("c")).otherwise(0))
    base = both.groupBy("var_id", "group", "value").agg((own + ref).alias("t"), own.alias("mine"))
    return base, ["var_id", "group"], _long(who.sizes, F.col("group")) + F.lit(float(who.sizes[who.reference]))


def mann_whitney(data: ExprData, who: Comparison, continuity: bool = True) -> DataFrame:
    """group, var_id, u (pairs where the group's value is larger, ties half) and z, by the normal form with ties."""
    base, keys, n_all = _tied(data, who)
    # A key's values are cut into bands of nearly equal ones, so that no task has to order all values of a variable; what
    # is summed over a whole key has a row for each band, of which there are at most a few thousand for any doubles.
    level = F.floor(F.log2(F.abs(F.col("value"))) * 8.0)
    base = base.withColumn("band", F.when(F.col("value") > 0, level + BANDS).otherwise(-level - BANDS))
    bands = base.groupBy(*keys, "band").agg(F.sum("t").alias("held"))
    along, whole = Window.partitionBy(*keys).orderBy("band"), Window.partitionBy(*keys)
    zeros = n_all - F.sum("held").over(whole).cast("double")
    negative = F.coalesce(F.sum(F.when(F.col("band") < 0, F.col("held"))).over(whole), F.lit(0)).cast("double")
    ahead = F.coalesce(F.sum("held").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    bands = bands.select(*keys, "band", ahead.alias("ahead"), zeros.alias("zeros"), negative.alias("negative"))
    # A key's bands are one row, which meets its values where they have been dealt to already.
    bands = bands.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("band", "ahead"))).alias("aheads"), F.first("zeros").alias("zeros"), F.first("negative").alias("negative"))
    t = F.col("t").cast("double")
    inside = Window.partitionBy(*keys, "band").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.element_at("aheads", F.col("band")) + F.coalesce(F.sum("t").over(inside), F.lit(0)).cast("double")
    ranked = base.join(bands, keys)
    ranked = ranked.withColumns({"rank": below + F.when(F.col("value") > 0, F.col("zeros")).otherwise(0.0) + (t + 1.0) / 2.0, "tie": t * t * t - t})
    names = F.array(*map(F.lit, who.tested)) if who.tested else F.array().cast("array<string>")
    if who.reference is None:
        ranked = ranked.withColumn("group", F.explode(names)).withColumn("mine", F.coalesce(F.try_element_at("at", F.col("group")), F.lit(0)))
    sums = ranked.groupBy("var_id", "group").agg(
        F.sum(F.col("rank") * F.col("mine")).alias("r"), F.sum("mine").cast("double").alias("stored"), F.sum("tie").alias("tie"), F.first("zeros").alias("zeros"), F.first("negative").alias("negative")
    )
    every = data.var.select("var_id").withColumn("group", F.explode(names)).join(sums, ["var_id", "group"], "left")
    n = _long(who.sizes, F.col("group"))
    m = F.lit(float(who.n_obs)) - n if who.reference is None else F.lit(float(who.sizes[who.reference]))
    total = n_all if who.reference is not None else F.lit(float(who.n_obs))
    # A group compared with itself is ranked among its own observations twice.
    z_all = F.coalesce(F.col("zeros"), total)
    zero_rank = F.coalesce("negative", F.lit(0.0)) + (z_all + 1.0) / 2.0
    r = F.coalesce("r", F.lit(0.0)) + (n - F.coalesce("stored", F.lit(0.0))) * zero_rank
    u = r - n * (n + 1.0) / 2.0
    ties = F.coalesce("tie", F.lit(0.0)) + z_all * z_all * z_all - z_all
    sd2 = n * m / 12.0 * ((total + 1.0) - ties / (total * (total - 1.0)))
    off = u - n * m / 2.0
    shift = F.lit(0.5 if continuity else 0.0)
    size = F.greatest(F.abs(off) - shift, F.lit(0.0))
    z = F.when((n > 0) & (m > 0) & (sd2 > 0), F.signum(off) * size / F.sqrt(sd2)).when((n > 0) & (m > 0), 0.0)
    return every.select("group", "var_id", F.when((n > 0) & (m > 0), u).alias("u"), z.alias("z"))


def mann_whitney_p(data: ExprData, who: Comparison, pairs: int = EXACT_PAIRS, continuity: bool = True) -> DataFrame:
    """group, var_id, u, z, pval and exact: whether pval is from the distribution of u itself, over all ways to choose the group
    among the observed values, ties included.

    It is where a group and what it is compared with make at most so many pairs, and else from the normal form; null without a
    pair. A variable's ties are then a few hundred numbers at most, as so many pairs have no more than pairs + 1 observations, and
    groups of the same size and ties share the counting. A group that is the reference too is in the normal form."""
    scores = mann_whitney(data, who, continuity)
    other = {g: who.n_obs - who.sizes[g] if who.reference is None else who.sizes[who.reference] for g in who.tested}
    small = [g for g in who.tested if 0 < who.sizes[g] * other[g] <= pairs and g != who.reference]
    if not small:
        return scores.select("*", normal_p(F.col("z")).alias("pval"), F.lit(False).alias("exact"))
    base, keys, n_all = _tied(data, who)
    if who.reference is not None:
        base = base.where(F.col("group").isin(small))
    own = F.sort_array(F.collect_list(F.struct("value", "t")))
    blocks = base.groupBy(*keys).agg(own.alias("own"))  # one for each value, of at most pairs + 1 observations
    zeros = (n_all - F.aggregate("own", F.lit(0.0), lambda n, b: n + b["t"])).cast("long")
    sides = [F.transform(F.filter("own", side), lambda b: b["t"]) for side in (lambda b: b["value"] < 0, lambda b: b["value"] > 0)]
    blocks = blocks.select(*keys, F.concat(sides[0], F.when(zeros > 0, F.array(zeros)).otherwise(F.array().cast("array<long>")), sides[1]).alias("blocks"))
    rows = scores.join(blocks, keys, "left").withColumn("exact", F.col("group").isin(small))
    n, m = _long(who.sizes, F.col("group")), _long(other, F.col("group"))
    # A variable without entries is one block of zeros.
    rows = rows.withColumn("blocks", F.when(F.col("exact"), F.coalesce("blocks", F.array((n + m).cast("long")))))
    p = F.when(F.col("exact"), exact_rank_p(n, m, F.col("u"), F.col("blocks"))).otherwise(normal_p(F.col("z")))
    return rows.select("group", "var_id", "u", "z", p.alias("pval"), "exact")


def rank_gene_groups_dataframe(
    data: ExprData,
    groupby: str,
    reference: str | None = None,
    groups: Sequence[str] | None = None,
    method: TestMethod = TestMethod.WELCH,
    n_genes: int | None = None,
    correction: Correction = Correction.BENJAMINI_HOCHBERG,
    compute_logfoldchanges: bool = True,
    pseudocount: float = 1.0,
    exact_pairs: int = 0,
) -> DataFrame:
    """group, reference, gene, score, pval, pval_adj, logfoldchange and rank (from 1): the n_genes best of each group, by
    adjusted p, p and order of variables. The correction is over all variables, whatever n_genes is. Mann-Whitney's p is exact for
    groups with at most exact_pairs pairs of observations (mann_whitney_p)."""
    if not isinstance(method, TestMethod):
        raise ValueError(f"no test {method}")
    who = resolve(data, groupby, reference, groups)
    sums = group_sums(data, who)
    sums = log_fold_change(sums, pseudocount) if compute_logfoldchanges else sums.withColumn("logfoldchange", F.lit(0.0))
    silent = (_mean("") == 0) & (_mean("_ref") == 0)
    if method is TestMethod.MANN_WHITNEY:
        tested = sums.join(mann_whitney_p(data, who, exact_pairs), ["group", "var_id"])
        score, p = F.col("u"), F.col("pval")
    else:
        tested = t_statistics(sums, method)
        score, p = F.col("t"), student_p(F.col("t"), F.col("df"))
    tested = tested.withColumns({"score": F.when(silent, 0.0).otherwise(score), "pval": F.when(silent, 1.0).otherwise(F.nanvl(p, F.lit(None).cast("double")))})
    adjusted = apply_correction(tested, "group", "pval", "var_id", correction)
    order = Window.partitionBy("group").orderBy(F.col("pval_adj").asc_nulls_last(), F.col("pval").asc_nulls_last(), "var_id")
    ranked = adjusted.withColumn("rank", F.row_number().over(order))
    if n_genes is not None:
        ranked = ranked.where(F.col("rank") <= n_genes)
    name = "var_name" if "var_name" in data.var.columns else "var_id"
    named = ranked.join(data.var.select("var_id", F.col(name).cast("string").alias("gene")), "var_id")
    return named.select("group", F.lit(who.reference or REST).alias("reference"), "gene", "score", "pval", "pval_adj", "logfoldchange", "rank")


def rank_gene_groups(data: ExprData, groupby: str, reference: str | None = None, groups: Sequence[str] | None = None, key_added: str | None = None, **options: Any) -> ExprData:
    """The container with wide tables in uns, a column for each group and a row for each rank, and what was asked for.

    The tables are views of one, which is kept after its first use, so the tests run once."""
    rows = rank_gene_groups_dataframe(data, groupby, reference, groups, **options)
    who = resolve(data, groupby, reference, groups)
    base = "rank_genes_groups" + (f"_{key_added}" if key_added else "")
    columns = {"scores": "score", "pvals": "pval", "pvals_adj": "pval_adj", "logfoldchanges": "logfoldchange", "names": "gene"}
    cell = F.first(F.struct(*(F.col(column).alias(name) for name, column in columns.items())))
    wide = rows.groupBy("rank").pivot("group", who.tested).agg(cell).persist()
    found = {f"{base}_{name}": wide.select("rank", *(F.col(_quoted(g))[name].alias(g) for g in who.tested)) for name in columns}
    told = {"params_reference": who.reference or REST, "params_method": str(options.get("method", TestMethod.WELCH).value), "params_groupby": groupby, "groups": who.tested}
    return data.with_(uns={**data.uns, **found, **{f"{base}_{k}": v for k, v in told.items()}})


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def obs_of_group(data: ExprData, groupby: str, group: str) -> DataFrame:
    """obs_id of a group; a group without observations is an error."""
    resolve(data, groupby, None, [group])
    return data.obs.where(F.col(groupby).cast("string") == group).select("obs_id")


