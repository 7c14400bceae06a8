"""The registered queries, over a matrix of customers and parts.

An entry is the quantity that a customer ordered of a part; customers are observations in groups by market segment, and
parts are variables. Doubles are rounded to six places, as engines add up in different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.corrections import Correction, apply_correction
from tesserae.operators import diffexp, filtering, hvg, qc, selection, statistics, transform
from tesserae.operators.pca import PCAResult, SVDMethod, run_pca
from tesserae.plans.data import Direction, ExprData, with_index
from tesserae.sources.annotations import network, reshape

ROW, COLUMN = Direction.ROW, Direction.COLUMN
TOP = (5, 10, 20)

#: Cells of a dense row that are added up in one row of Spark's.
CELLS = 8

Query = Callable[[SparkSession, str], DataFrame]


def orders_matrix(spark: SparkSession, sf_dir: str) -> ExprData:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    x = both.select(F.col("o_custkey").alias("obs_id"), F.col("l_partkey").alias("var_id"), F.col("l_quantity").alias("value"))
    obs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("obs_id"), F.col("c_name").alias("obs_name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    var = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("var_id"), F.col("p_name").alias("var_name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return ExprData.from_frames(x, obs, var.withColumn("small", F.col("size") <= 10))


def logged(spark: SparkSession, sf_dir: str) -> ExprData:
    """The matrix scaled to 10000 for each customer, in logarithms."""
    return transform.log1p_expression(transform.normalize_expression(orders_matrix(spark, sf_dir), 10_000))


def embedding_matrix(spark: SparkSession, sf_dir: str) -> ExprData:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.select(F.col("vec_id").alias("obs_id"), F.posexplode("embedding").alias("var_id", "value"))
    width = table.select(F.max(F.size("embedding"))).first()[0]
    return ExprData.from_frames(rows, table.select(F.col("vec_id").alias("obs_id")), spark.range(max(0, width or 0)).select(F.col("id").alias("var_id")))


def nations_matrix(spark: SparkSession, sf_dir: str) -> ExprData:
    """Parts ordered from each nation; nations are observations in groups of five by region."""
    data = orders_matrix(spark, sf_dir)
    x = data.x.join(data.obs.select("obs_id", "nation"), "obs_id").select(F.col("nation").cast("long").alias("obs_id"), "var_id", "value")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return ExprData.from_frames(x, nation.select(F.col("n_nationkey").cast("long").alias("obs_id"), F.col("n_regionkey").cast("string").alias("region")), data.var)


def places_matrix(spark: SparkSession, sf_dir: str) -> ExprData:
    """Parts ordered from each market segment of each nation."""
    data = orders_matrix(spark, sf_dir)
    obs = data.obs.select("nation", "segment").distinct()
    obs = obs.withColumn("obs_id", F.row_number().over(Window.orderBy("nation", "segment")).cast("long"))  # five segments of each nation
    places = data.obs.select(F.col("obs_id").alias("customer"), "nation", "segment").join(obs, ["nation", "segment"])
    x = data.x.join(places, data.x.obs_id == places.customer).select(places.obs_id, "var_id", "value")
    return ExprData.from_frames(x, obs, data.var)


def rounded(rows: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to some places, with a zero that has no sign."""
    return rows.select(*((F.round(F.col(f"`{n}`"), places) + F.lit(0.0)).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in rows.dtypes))


def _matrix(f: Callable[[ExprData], DataFrame], load: Callable[[SparkSession, str], ExprData] = orders_matrix) -> Query:
    return lambda spark, sf_dir: rounded(f(load(spark, sf_dir)))


def _both(f: Callable[[ExprData, Direction], DataFrame], direction: Direction) -> Query:
    return _matrix(lambda data: f(data, direction))


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in column of p-values: a test for each part within its brand, with ties."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_brand").alias("family"), F.col("p_partkey").cast("long").alias("test"), ((F.col("p_partkey") * 7919 % 1009).cast("double") / F.lit(1009.0).cast("double")).alias("p"))


def _corrected(method: Correction) -> Query:
    return lambda spark, sf_dir: rounded(apply_correction(_p_values(spark, sf_dir), "family", "p", "test", method), 9)


def _corrected_together(method: Correction) -> Query:
    """All parts as one family."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tests = _p_values(spark, sf_dir).withColumn("family", F.lit("all"))
        return rounded(apply_correction(tests, "family", "p", "test", method, split=True).select("test", "p", "pval_adj"), 9)

    return run


def _annotations(part: DataFrame) -> DataFrame:
    """Parts as annotated genes, a row for each label: all have a species, and those above a size a cell type too."""
    labels = F.map_from_arrays(F.array(F.lit("cell_type"), F.lit("ncbi_tax_id")), F.array(F.when(F.col("p_size") > 5, F.col("p_brand")), F.when(F.col("p_size") <= 25, "9606").otherwise("10090")))
    rows = part.select(F.col("p_name").alias("genesymbol"), F.col("p_partkey").alias("record_id"), F.explode(labels).alias("label", "value"))
    return rows.where("value is not null")


def annotation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape(_annotations(spark.read.parquet(f"{sf_dir}/part.parquet")), "9606", ["cell_type", "ncbi_tax_id"])


def annotation_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as sets of parts by name: those of at least two."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return network(part.select("p_brand", "p_name"), "p_brand", "p_name", part.where(F.col("p_size") <= 25).select(F.col("p_name").alias("var_name")), 2)


def _groups(data: ExprData, reference: str | None = None) -> diffexp.Comparison:
    return diffexp.resolve(data, "segment", reference)


def _t(method: diffexp.TestMethod) -> Query:
    return _matrix(lambda d: diffexp.t_statistics(diffexp.group_sums(d, _groups(d)), method).select("group", "var_id", "t", "df"))


def _tests(method: diffexp.TestMethod, n_genes: int | None) -> Query:
    return _matrix(lambda d: diffexp.rank_gene_groups_dataframe(d, "segment", method=method, n_genes=n_genes), logged)


def _exact(reference: str | None) -> Query:
    def run(data: ExprData) -> DataFrame:
        return diffexp.mann_whitney_p(data, diffexp.resolve(data, "region", reference)).where(F.col("exact")).select("group", "var_id", "u", "pval")

    return _matrix(run, nations_matrix)


def _indexed(data: ExprData) -> ExprData:
    return data.with_(obs=with_index(data.obs, "obs_id", "obs_idx"), var=with_index(data.var, "var_id", "var_idx"))


def _hvg(**options: object) -> Query:
    return _matrix(lambda d: hvg.seurat(d, hvg.HVGParams(**options)))


def _percentile(**options: object) -> Query:
    return _matrix(lambda d: hvg.percentile(d, hvg.HVGParams(flavor=hvg.Flavor.CELL_RANGER, **options)))


def _row_sums(pieces: DataFrame) -> DataFrame:
    """What tells dense rows, given in pieces, apart without writing them out: their length, sum, and sum weighted by place.

    A row in Spark has CELLS of them, as one for each took several times as long."""
    cuts = F.explode(F.sequence(F.lit(0), F.size("row") - 1, F.lit(CELLS)))
    each = pieces.select("obs_id", "start", "row", cuts.alias("cut"))
    cells = [F.coalesce(F.get("row", F.col("cut") + i), F.lit(0.0)).alias(f"v{i}") for i in range(CELLS)]  # none beyond a piece
    at = F.col("start").cast("long") + F.col("cut")  # products of places are beyond 32 bits
    each = each.select("obs_id", F.least(F.lit(CELLS), F.size("row") - F.col("cut")).alias("n"), at.cast("double").alias("at"), (at * 7919 % 1009).cast("double").alias("mix"), *cells)

    def over(of: Callable[[Column, int], Column]) -> Column:
        return reduce(add, [of(F.col(f"v{i}"), i) for i in range(CELLS)])

    def mixed(v: Column, i: int) -> Column:
        more = float(i * 7919 % 1009)
        return v * (F.col("mix") + F.when(F.col("mix") >= 1009 - more, more - 1009).otherwise(more))

    sums = {"total": over(lambda v, i: v), "weighted": over(lambda v, i: v * (F.col("at") + (i + 1.0))), "mixed": over(mixed)}
    return each.groupBy("obs_id").agg(F.sum("n").alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))


def _qc_inplace(data: ExprData) -> DataFrame:
    return qc.calculate_qc_metrics(data, qc_vars=["small"], percent_top=TOP, inplace=True, log1p=True).obs.drop("obs_name", "nation")


def _qc_mito(data: ExprData) -> DataFrame:
    """Small parts by names that begin as mitochondrial genes do."""
    named = data.var.withColumn("var_name", F.when(F.col("small"), F.concat(F.lit("MT-"), "var_name")).otherwise(F.col("var_name")))
    return qc.qc_metrics(data.with_(var=named), TOP).obs.drop("obs_name", "nation", "segment")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and scores of the wide tables of a test against one group, a column for each group and table."""
    uns = diffexp.rank_gene_groups(logged(spark, sf_dir), "segment", "BUILDING", ["AUTOMOBILE", "MACHINERY"], key_added="q", n_genes=40).uns
    names, scores = (uns[f"rank_genes_groups_q_{what}"] for what in ("names", "scores"))
    both = names.join(scores.withColumnsRenamed({"AUTOMOBILE": "score_AUTOMOBILE", "MACHINERY": "score_MACHINERY"}), "rank")
    return rounded(both)


def _components(of: Callable[[PCAResult], DataFrame], key: str = "", values: str = "") -> Query:
    """Ten components of the embeddings; arrays as a column for each component."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = of(run_pca(embedding_matrix(spark, sf_dir), selection.FeatureSelection(), True, 10))
        return rounded(rows.select(key, *(F.get(values, F.lit(i)).alias(f"c{i}") for i in range(10))) if values else rows)

    return run


def _space(of: Callable[[PCAResult], DataFrame], key: str = "", values: str = "") -> Query:
    """Five components of all parts by a Krylov space."""

    def run(data: ExprData) -> DataFrame:
        rows = of(run_pca(data, selection.FeatureSelection(), True, 5, svd_method=SVDMethod.RANDOMIZED))
        return rounded(rows.select(key, *(F.get(values, F.lit(i)).alias(f"c{i}") for i in range(5))), 4) if values else rows

    return _matrix(run, places_matrix)


def _features(data: ExprData, chosen: selection.FeatureSelection) -> DataFrame:
    return selection.select_features(data, chosen)


QUERIES: dict[str, Query] = {
    "obs_nonzero_sum": _both(statistics.count_and_total, ROW),
    "var_nonzero_sum": _both(statistics.count_and_total, COLUMN),
    "masked_nonzero_sum": _matrix(lambda d: statistics.count_and_total(d, ROW, F.col("small"))),
    "masked_var_nonzero_sum": _matrix(lambda d: statistics.count_and_total(d, COLUMN, F.col("segment") == "BUILDING")),
    "obs_nonzero": _both(statistics.nonzero, ROW),
    "var_total": _both(statistics.total, COLUMN),
    "obs_variance": _both(statistics.variance, ROW),
    "var_variance": _both(statistics.variance, COLUMN),
    "obs_min_max": _both(statistics.min_max, ROW),
    "var_min_max": _both(statistics.min_max, COLUMN),
    "obs_top_n": _matrix(lambda d: statistics.n_top(d, ROW, 5).select("obs_id", F.array_join("top", ",").alias("top"))),
    "var_top_n": _matrix(lambda d: statistics.n_top(d, COLUMN, 5).select("var_id", F.array_join("top", ",").alias("top"))),
    "obs_top_segment_proportions": _matrix(lambda d: statistics.top_segment_proportions(d, ROW, TOP)),
    "var_top_segment_proportions": _matrix(lambda d: statistics.top_segment_proportions(d, COLUMN, TOP)),
    "qc_obs": _matrix(lambda d: qc.describe_obs(d, "counts", "genes", ["small"], TOP, True)),
    "qc_var": _matrix(lambda d: qc.describe_var(d, "counts", True)),
    "qc_calculate_inplace": _matrix(_qc_inplace),
    "qc_mitochondrial": _matrix(_qc_mito),
    "filter_cells": _matrix(lambda d: filtering.mark_filter_cells(d, min_genes=10, max_counts=1500, min_fraction=0.01)),
    "filter_genes": _matrix(lambda d: filtering.mark_filter_genes(d, min_cells=20, min_counts=500, max_fraction=0.5)),
    "select_obs": _matrix(lambda d: selection.get_select_info_obs(d, F.col("segment") == "BUILDING").x),
    "select_vars": _matrix(lambda d: selection.get_select_info_vars(d, F.col("small")).x),
    "select_slice": lambda spark, sf_dir: selection.select_indices(orders_matrix(spark, sf_dir), ROW, selection.Slice(3, None, 7)),
    "select_list": lambda spark, sf_dir: selection.select_indices(orders_matrix(spark, sf_dir), COLUMN, [5, 0, 5, 17]),
    "densify_selected": _matrix(lambda d: selection.densify_selected(d, selection.Slice(0, 100, 3), [4, 0, 4, 9, 150]).select("position", "obs_id", F.array_join("row", ",").alias("row"))),
    "densify": _matrix(lambda d: _row_sums(selection.dense_pieces(d))),
    "feature_selection_full": _matrix(lambda d: _features(d, selection.FeatureSelection())),
    "feature_selection_hvg": _matrix(lambda d: _features(d, selection.FeatureSelection(selection.Method.HIGHLY_VARIABLE, column="small"))),
    "feature_selection_random": _matrix(lambda d: _features(d, selection.FeatureSelection(selection.Method.RANDOM, count=50))),
    "feature_selection_variance": _matrix(lambda d: _features(d, selection.FeatureSelection(selection.Method.VARIANCE, threshold=30.0))),
    "normalize_row": _matrix(lambda d: transform.normalize_expression(d, 10_000, ROW).x),
    "normalize_col": _matrix(lambda d: transform.normalize_expression(d, 10_000, COLUMN).x),
    "convert_to_single": _matrix(lambda d: transform.convert_to_float(d.x.select("obs_id", "var_id", (F.col("value") / 3.0).alias("value")), "single").withColumn("value", F.col("value").cast("double"))),
    "convert_array": _matrix(lambda d: selection.densify_selected(d, selection.Slice(0, 100, 3), [4, 0, 4, 9]).select("position", F.transform(transform.convert_array(F.transform("row", lambda v: v / 3.0), "single"), lambda v: v.cast("double")).alias("row")).select("position", *(F.get("row", i).alias(f"c{i}") for i in range(4)))),
    "wide_frame": _matrix(lambda d: transform.frame_from_groups(diffexp.group_sums(d, _groups(d)), "var_id", "group", "s", _groups(d).tested)),
    "log1p": _matrix(lambda d: transform.log1p_expression(d).x),
    "hvg_seurat_cutoff": _hvg(max_mean=100.0),
    "hvg_seurat_topn": _hvg(n_top_genes=50),
    "hvg_by_batch": _matrix(lambda d: hvg.normalized_by_batch(hvg.dispersions(hvg.moments(d)).join(d.var.select("var_id", "brand"), "var_id"), 5, "brand").select("var_id", "dispersions_norm")),
    "hvg_equal_frequency_bins": _matrix(lambda d: hvg.equal_frequency_bins(hvg.dispersions(hvg.moments(d)), 7).select("var_id", "means", "bin")),
    "hvg_dispatch": _matrix(lambda d: hvg.compute_highly_variable_genes(d, hvg.HVGParams(n_top_genes=50)).var.select("var_id", "var_name", "means", "dispersions", "dispersions_norm", "highly_variable")),
    "hvg_percentile": _percentile(min_mean=0.3, max_mean=6.0),
    "hvg_percentile_topn": _percentile(n_bins=7, n_top_genes=40, min_mean=-1.0, max_mean=float("inf")),
    "hvg_loess": _matrix(lambda d: hvg.loess(d, hvg.HVGParams(flavor=hvg.Flavor.LOESS, span=0.5, min_dispersion=1.0, max_mean=100.0))),
    "hvg_loess_batches": _matrix(lambda d: hvg.loess(d, hvg.HVGParams(flavor=hvg.Flavor.LOESS, batch_key="segment", n_top_genes=60))),
    "hvg_svr": _matrix(lambda d: hvg.svr(d, hvg.HVGParams(n_top_genes=200, flavor=hvg.Flavor.SVR))),
    "de_group_sums": _matrix(lambda d: diffexp.group_sums(d, _groups(d))),
    "de_logfc": _matrix(lambda d: diffexp.log_fold_change(diffexp.group_sums(d, _groups(d))).select("group", "var_id", "logfoldchange"), logged),
    "de_welch_stat": _t(diffexp.TestMethod.WELCH),
    "de_student_stat": _t(diffexp.TestMethod.STUDENT),
    "de_welch_reference": _matrix(lambda d: diffexp.t_statistics(diffexp.group_sums(d, _groups(d, "BUILDING")), diffexp.TestMethod.WELCH).select("group", "var_id", "t", "df")),
    "de_some_groups": _matrix(lambda d: diffexp.t_statistics(diffexp.group_sums(d, diffexp.resolve(d, "segment", None, ["MACHINERY", "FURNITURE"])), diffexp.TestMethod.WELCH).select("group", "var_id", "t", "df")),
    "de_group_members": _matrix(lambda d: diffexp.obs_of_group(d, "segment", "BUILDING")),
    "de_mannwhitney_u": _matrix(lambda d: diffexp.mann_whitney(d, _groups(d))),
    "de_mannwhitney_reference": _matrix(lambda d: diffexp.mann_whitney(d, _groups(d, "BUILDING"))),
    "de_mannwhitney_exact": _exact(None),
    "de_mannwhitney_exact_reference": _exact("1"),
    "rank_gene_groups_exact": _matrix(lambda d: diffexp.rank_gene_groups_dataframe(d, "region", method=diffexp.TestMethod.MANN_WHITNEY, exact_pairs=diffexp.EXACT_PAIRS).select("group", "gene", "score", "pval", "pval_adj"), nations_matrix),
    "de_pvalues": _tests(diffexp.TestMethod.WELCH, None),
    "rank_gene_groups": _tests(diffexp.TestMethod.MANN_WHITNEY, 25),
    "rank_gene_groups_stored": _stored,
    "correct_bonferroni": _corrected(Correction.BONFERRONI),
    "correct_bh": _corrected(Correction.BENJAMINI_HOCHBERG),
    "correct_by": _corrected(Correction.BENJAMINI_YEKUTIELI),
    "correct_holm": _corrected(Correction.HOLM),
    "correct_hochberg": _corrected(Correction.HOCHBERG),
    "correct_storey": _corrected(Correction.STOREY),
    "correct_bonferroni_split": _corrected_together(Correction.BONFERRONI),
    "correct_bh_split": _corrected_together(Correction.BENJAMINI_HOCHBERG),
    "correct_by_split": _corrected_together(Correction.BENJAMINI_YEKUTIELI),
    "correct_holm_split": _corrected_together(Correction.HOLM),
    "correct_hochberg_split": _corrected_together(Correction.HOCHBERG),
    "correct_storey_split": _corrected_together(Correction.STOREY),
    "pca_scores": _components(lambda found: found.scores, "obs_id", "score"),
    "pca_variance": _components(lambda found: found.variance),
    "pca_loadings": _components(lambda found: found.loadings, "var_id", "loading"),
    "pca_space_variance": _space(lambda found: found.variance),
    "pca_space_loadings": _space(lambda found: found.loadings, "var_id", "loading"),
    "annotation_pivot": annotation_pivot,
    "network": annotation_network,
}
