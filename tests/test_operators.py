import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import diffexp, filtering, hvg, pca, qc, selection, statistics, subspace, transform, trend
from tesserae.plans.data import Direction, ExprData, with_index
from tesserae.plans.queries import CELLS, QUERIES, _row_sums
from tests.fixtures import container, three_groups

ROW, COLUMN = Direction.ROW, Direction.COLUMN
SPARSE = np.array([[0, 2, 0, -1, 0], [3, 0, 0, 4, 0], [0, 0, 0, 0, 0], [1, 2, 0, 2, 0]], dtype=float)


def column(df, key, name):
    return [r[name] for r in df.orderBy(key).collect()]


@pytest.mark.parametrize("direction", list(Direction))
def test_statistics_count_zeros(spark, direction):
    data, axis = container(spark, SPARSE), 1 if direction is ROW else 0
    key = direction.key
    assert column(statistics.nonzero(data, direction), key, "n") == (SPARSE != 0).sum(axis=axis).tolist()
    assert column(statistics.total(data, direction), key, "total") == SPARSE.sum(axis=axis).tolist()
    assert column(statistics.variance(data, direction), key, "variance") == pytest.approx(SPARSE.var(axis=axis, ddof=1).tolist())
    assert column(statistics.min_max(data, direction), key, "min") == SPARSE.min(axis=axis).tolist()
    assert column(statistics.min_max(data, direction), key, "max") == SPARSE.max(axis=axis).tolist()
    rows = SPARSE if direction is ROW else SPARSE.T
    ordered = -np.sort(-rows, axis=1)
    for n in (1, 3, rows.shape[1]):
        assert column(statistics.n_top(data, direction, n), key, "top") == ordered[:, :n].tolist()
    total = rows.sum(axis=1)
    found = statistics.top_segment_proportions(data, direction, [2, 2, rows.shape[1]])
    assert found.columns == [key, "top_2", f"top_{rows.shape[1]}"]
    want = np.where(total > 0, ordered[:, :2].sum(axis=1) / np.where(total > 0, total, 1), 0)
    assert column(found.na.fill(0.0), key, "top_2") == pytest.approx(want.tolist())
    with pytest.raises(ValueError):
        statistics.n_top(data, direction, rows.shape[1] + 1)


def test_explicit_zeros_nulls_and_repeats_are_canonical(spark):
    x = spark.createDataFrame([(0, 0, 1.5), (0, 0, 1.5), (0, 1, 0.0), (1, 1, None), (1, 0, 2.0), (1, 0, -2.0)], "obs_id int, var_id int, value double")
    data = ExprData.from_frames(x, spark.range(2).withColumnRenamed("id", "obs_id"), spark.range(2).withColumnRenamed("id", "var_id"))
    assert [tuple(r) for r in data.x.collect()] == [(0, 0, 3.0)]


def test_masks_treat_null_as_false(spark):
    data = container(spark, SPARSE)
    data = data.with_(var=data.var.withColumn("m", F.when(F.col("var_id") == 0, True).when(F.col("var_id") == 1, False)))
    assert column(statistics.total(data, ROW, F.col("m")), "obs_id", "total") == [0.0, 3.0, 0.0, 1.0]


def test_empty_matrix(spark):
    data = container(spark, np.zeros((2, 3)))
    assert column(statistics.nonzero(data, ROW), "obs_id", "n") == [0, 0]
    assert column(statistics.variance(data, COLUMN), "var_id", "variance") == [0.0] * 3
    assert qc.describe_var(data, "counts", False).count() == 3


def test_qc_names_values_and_errors(spark):
    data = container(spark, SPARSE, names=["MT-1", "mt-2", "Mt-3", "a", "b"])
    done = qc.qc_metrics(data, percent_top=[1, 2])
    assert column(done.var, "var_id", "mito") == [True, True, False, False, False]
    assert [c for c in done.obs.columns if c.startswith("pct")] == ["pct_counts_in_top_1_genes", "pct_counts_in_top_2_genes", "pct_counts_mito"]
    row = done.obs.where("obs_id = 3").first()
    assert row["total_counts_mito"] == 3.0 and row["pct_counts_mito"] == pytest.approx(60.0) and row["log1p_total_counts"] == pytest.approx(np.log1p(5))
    assert done.obs.where("obs_id = 2").first()["pct_counts_mito"] == 0.0
    assert done.var.where("var_id = 0").first()["pct_dropout_by_counts"] == pytest.approx(50.0)
    with pytest.raises(ValueError):
        qc.calculate_qc_metrics(data)
    with pytest.raises(ValueError):
        qc.calculate_qc_metrics(data, percent_top=[], use_raw=True)
    with pytest.raises(ValueError):
        qc.calculate_qc_metrics(data, percent_top=[], qc_vars=["var_name"])
    layered = data.with_(layers={"twice": data.x.withColumn("value", F.col("value") * 2)})
    obs, _ = qc.calculate_qc_metrics(layered, percent_top=[], layer="twice", use_raw=True)
    assert column(obs, "obs_id", "total_counts") == [2.0, 14.0, 0.0, 10.0]


def test_filters_are_inclusive_and_lazy(spark):
    data = container(spark, np.abs(SPARSE))
    assert column(filtering.mark_filter_cells(data, min_genes=2, max_counts=5), "obs_id", "keep") == [True, False, False, True]
    assert column(filtering.mark_filter_cells(data), "obs_id", "keep") == [True] * 4
    assert column(filtering.mark_filter_genes(data, min_fraction=0.5, max_cells=2), "var_id", "keep") == [True, True, False, False, False]


def test_selection(spark):
    data = container(spark, SPARSE)
    listed = selection.select_indices(data, COLUMN, [3, 0, 3])
    assert [tuple(r) for r in listed.orderBy("position").collect()] == [(0, 3), (1, 0), (2, 3)]
    assert column(selection.select_indices(data, COLUMN, selection.Slice(1, None, 2)), "position", "var_id") == [1, 3]
    for wrong in ([5], [-1], selection.Slice(0, 6)):
        with pytest.raises(ValueError):
            selection.select_indices(data, COLUMN, wrong)
    picked = selection.densify_selected(data, [3, 0], [3, 0, 3])
    assert column(picked, "position", "row") == SPARSE[[3, 0]][:, [3, 0, 3]].tolist()
    assert column(selection.densify(data), "obs_id", "row") == SPARSE.tolist()
    assert selection.get_select_info_obs(data, None) is data
    random = selection.FeatureSelection(selection.Method.RANDOM, count=3, seed=7)
    assert column(selection.select_features(data, random), "var_id", "var_id") == column(selection.select_features(data, random), "var_id", "var_id")
    assert selection.select_features(data, random).count() == 3
    assert selection.FlexValue(relative=0.5).is_relative() and selection.FlexValue().is_none() and selection.FlexValue(1.0).is_some()


def test_index_is_dense_over_gaps(spark):
    ids = spark.createDataFrame([(i,) for i in (-70000, 5, 65536, 1 << 40, 6)], "obs_id long")
    assert [tuple(r) for r in with_index(ids, "obs_id", "at").orderBy("obs_id").collect()] == [(-70000, 0), (5, 1), (6, 2), (65536, 3), (1 << 40, 4)]


def test_transformations(spark):
    data = container(spark, np.array([[1.0, 3.0], [0.0, 0.0], [2.0, -2.0]]))
    rows = selection.densify(transform.normalize_expression(data, 100, ROW))
    assert column(rows, "obs_id", "row") == [[25.0, 75.0], [0.0, 0.0], [2.0, -2.0]]
    assert dict(transform.log1p_expression(data, "single").x.dtypes)["value"] == "float"
    whole = spark.createDataFrame([(0, 0, 3)], "obs_id long, var_id long, value int")
    assert dict(transform.convert_to_float(whole, "single").dtypes)["value"] == "float"
    with pytest.raises(TypeError):
        transform.convert_to_float(spark.createDataFrame([(0, 0, True)], "obs_id long, var_id long, value boolean"))
    with pytest.raises(ValueError):
        transform.convert_to_float(whole, "half")


def plain_seurat(dense, bins):
    """Step by step, with None where there is no value."""
    mean, var = dense.mean(axis=0), dense.var(axis=0, ddof=1)
    means = np.log(mean + 1)
    ratio = var / np.where(mean <= 1e-12, 1e-12, mean)
    disp = [np.log(v) if v > 0 else None for v in ratio]
    low, width = means.min(), (means.max() - means.min()) / bins
    place = [max(0, min(bins - 1, sum(low + i * width <= m for i in range(bins)) - 1)) for m in means]
    out = []
    for b, d in zip(place, disp, strict=True):
        own = [e for e, c in zip(disp, place, strict=True) if c == b and e is not None]
        m, sd = (np.mean(own) if own else None), (np.std(own, ddof=1) if len(own) > 1 else None)
        center, scale = (m, sd) if sd is not None else (0.0, m)
        out.append(None if d is None or not scale else (d - center) / scale)
    return out


def test_hvg_bins_of_one_of_equals_and_ties(spark):
    rng = np.random.default_rng(3)
    dense = rng.poisson(rng.uniform(0, 6, 12), size=(30, 12)).astype(float)
    dense[:, 0] = 0
    dense[:, 2] = dense[:, 1]
    data = container(spark, dense)
    rows = hvg.seurat(data, hvg.HVGParams(n_bins=4, n_top_genes=3)).orderBy("var_id").collect()
    want = plain_seurat(dense, 4)
    for r, w in zip(rows, want, strict=True):
        assert (r["dispersions_norm"] is None) == (w is None)
        assert w is None or r["dispersions_norm"] == pytest.approx(w, abs=1e-9)
    third = sorted((w for w in want if w is not None), reverse=True)[2]
    assert [r["highly_variable"] for r in rows] == [w is not None and w >= third - 1e-9 for w in want]
    assert not any(column(hvg.seurat(data, hvg.HVGParams(n_top_genes=0)), "var_id", "highly_variable"))


def plain_trend(x, y):
    n = len(x)
    s = (x - x.min()) / (x.max() - x.min())
    kernel = np.exp(-((s[:, None] - s[None, :]) ** 2) / n)
    w = np.zeros(n)
    for _ in range(100):
        for i in range(n):
            w[i] = (y[i] - sum(kernel[i, j] * w[j] for j in range(n) if j != i)) / (kernel[i, i] + 1.0)
    return kernel @ w


def test_trend_equals_plain_sweeps_and_spares_silent_variables(spark):
    rng = np.random.default_rng(5)
    dense = rng.poisson(rng.uniform(1, 9, 25), size=(40, 25)).astype(float)
    dense[:, 4], dense[:, 9] = 0, 2
    data = hvg.compute_highly_variable_genes(container(spark, dense), hvg.HVGParams(flavor=hvg.Flavor.SVR, n_top_genes=5, min_mean=0.0, max_mean=100.0))
    rows = data.var.orderBy("var_id").collect()
    fits = [j for j in range(25) if j not in (4, 9)]
    x, y = np.log(dense.mean(axis=0)[fits]), np.log(dense.var(axis=0, ddof=1)[fits])
    trend = plain_trend(x, y)
    assert [rows[j]["mean_variance_trend"] for j in fits] == pytest.approx(trend.tolist(), abs=1e-9)
    left = y - trend
    z = (left - left.mean()) / left.std(ddof=1)
    assert [rows[j]["residuals_standardized"] for j in fits] == pytest.approx(z.tolist(), abs=1e-9)
    assert {j for j in range(25) if rows[j]["highly_variable"]} == {fits[i] for i in np.argsort(-z)[:5]}
    assert rows[4]["residuals"] is None and rows[4]["residuals_standardized"] == 0.0


def test_trend_in_blocks_equals_plain_sweeps(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=60) * 2, rng.normal(size=60) + 3
    monkeypatch.setattr(trend, "BLOCK", 9)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "var_id long, a double, b double")
    found = rows.select("var_id", trend.kernel_trend(rows, "var_id", "a", "b").alias("t")).orderBy("var_id").collect()
    want = plain_trend(x, y)
    assert [r["t"] for r in found] == pytest.approx(want.tolist(), abs=1e-9)
    monkeypatch.setattr(trend, "STEP", 5)
    s, k = (x - x.min()) / (x.max() - x.min()), len(trend.scales(1 / 60))
    total = trend.chain([trend.responses(s[at : at + 17], y[at : at + 17], 1 / 60) for at in range(0, 60, 17)])
    features = np.exp(-s * s / 60)[:, None] * s[:, None] ** np.arange(k) * np.array(trend.scales(1 / 60))
    assert (features @ total).tolist() == pytest.approx(want.tolist(), abs=1e-9)
    one = rows.where("var_id = 0")
    assert one.select(trend.kernel_trend(one, "var_id", "a", "b")).first()[0] == pytest.approx(y[0] / 2, abs=1e-9)
    none = rows.where("false")
    assert rows.select(trend.kernel_trend(none, "var_id", "a", "b")).first()[0] is None


def test_components_equal_decomposition(spark):
    rng = np.random.default_rng(1)
    dense = np.where(rng.random((40, 8)) < 0.4, 0.0, rng.normal(size=(40, 8)) * np.arange(1, 9))
    dense[7] = 0
    data = container(spark, dense)
    for center in (True, False):
        found = pca.run_pca(data, selection.FeatureSelection(), center, 3)
        moved = dense - dense.mean(axis=0) if center else dense
        _, s, vt = np.linalg.svd(moved, full_matrices=False)
        vt = vt[:3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])[:, None]
        lines = found.variance.orderBy("component").collect()
        assert [r["explained_variance"] for r in lines] == pytest.approx((s[:3] ** 2 / 39).tolist())
        assert lines[-1]["cumulative"] == pytest.approx((s[:3] ** 2).sum() / (s**2).sum())
        assert np.array(column(found.scores, "obs_id", "score")) == pytest.approx(moved @ vt.T.copy(), abs=1e-8)
        assert np.array(column(found.loadings, "var_id", "loading")) == pytest.approx(vt.T, abs=1e-8)


def test_components_of_many_variables(spark, monkeypatch):
    """By a Krylov space, as where there are more variables than a Gram matrix may have; one observation and one variable are empty."""
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((60, 30)) < 0.5, 0.0, 1.0 + rng.normal(size=(60, 30)) * 1.3 ** -np.arange(30.0))
    dense[7], dense[:, 4] = 0, 0
    data = container(spark, dense)
    assert pca.run_pca(data, selection.FeatureSelection(), True, 3, svd_method=pca.SVDMethod.GRAM).loadings.count() == 30
    monkeypatch.setattr(pca, "MOST", 20)
    with pytest.raises(ValueError, match="at most 20"):
        pca.run_pca(data, selection.FeatureSelection(), True, 3, svd_method=pca.SVDMethod.GRAM)
    found = pca.run_pca(data, selection.FeatureSelection(), True, 3)
    moved = dense - dense.mean(axis=0)
    _, s, vt = np.linalg.svd(moved, full_matrices=False)
    vt = vt[:3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])[:, None]
    lines = found.variance.orderBy("component").collect()
    assert [r["explained_variance"] for r in lines] == pytest.approx((s[:3] ** 2 / 59).tolist(), rel=1e-10)
    assert lines[-1]["cumulative"] == pytest.approx((s[:3] ** 2).sum() / (s**2).sum(), rel=1e-10)
    assert np.array(column(found.scores, "obs_id", "score")) == pytest.approx(moved @ vt.T.copy(), abs=1e-5)
    assert np.array(column(found.loadings, "var_id", "loading")) == pytest.approx(vt.T, abs=1e-5)


def test_components_of_low_rank_and_of_nothing(spark):
    randomized = {"svd_method": pca.SVDMethod.RANDOMIZED, "n_components": 5}
    dense = np.outer(np.arange(1.0, 7), [1.0, 2.0, 0.0, 2.0])
    found = pca.run_pca(container(spark, dense), selection.FeatureSelection(), **randomized)
    assert [r["ratio"] for r in found.variance.collect()] == pytest.approx([1.0])
    assert np.array(column(found.loadings, "var_id", "loading")) == pytest.approx(np.array([[1], [2], [0], [2]]) / 3.0)
    nothing = pca.run_pca(container(spark, dense).with_(x=container(spark, dense).x.limit(0)), selection.FeatureSelection(), **randomized)
    assert nothing.variance.count() == 0 and [r["score"] for r in nothing.scores.collect()] == [[]] * 6


def test_multi_group_shape(spark):
    dense, labels = three_groups()
    data = diffexp.rank_gene_groups(container(spark, dense, labels), "segment", method=diffexp.TestMethod.STUDENT, n_genes=3)
    for name in ("scores", "pvals", "pvals_adj", "logfoldchanges", "names"):
        frame = data.uns[f"rank_genes_groups_{name}"]
        assert frame.columns == ["rank", "A", "B", "C"] and frame.count() == 3
    assert data.uns["rank_genes_groups_params_reference"] == "rest"
    best = data.uns["rank_genes_groups_names"].toPandas()
    assert set(best["A"]) < {"gene0", "gene3", "gene6", "gene9"} and set(best["C"]) == {"gene2", "gene5", "gene8"}


def test_close_components_are_found_and_failure_is_told(spark, monkeypatch):
    """A matrix of noise, whose eigenvalues lie close together; bases start again, and too few steps are an error."""
    dense = np.random.default_rng(8).normal(size=(150, 180))
    data, (_, s, _) = container(spark, dense), np.linalg.svd(dense - dense.mean(axis=0))
    monkeypatch.setattr(subspace, "LONGEST", 60)
    options = {"svd_method": pca.SVDMethod.RANDOMIZED, "n_components": 4}
    lines = pca.run_pca(data, selection.FeatureSelection(), True, **options).variance.orderBy("component").collect()
    assert [r["explained_variance"] for r in lines] == pytest.approx((s[:4] ** 2 / 149).tolist(), rel=1e-9)
    monkeypatch.setattr(subspace, "MOST_STEPS", 2)
    with pytest.raises(RuntimeError, match="2 steps"):
        pca.run_pca(data, selection.FeatureSelection(), True, **options)


def test_order_statistics_and_medians(spark):
    rng = np.random.default_rng(12)
    rows = [(k, float(v)) for k, n in (("a", 41), ("b", 40), ("c", 1), ("d", 2)) for v in rng.choice([-3.5, -1e-300, 0.0, 0.25, 2.0, 2.0000001, 1e200, 7.0], n)]
    rows += [("a", None), ("e", None), (None, 1.0)] + [("hot", float(v)) for v in np.repeat([1.0, 5.0, 1.5], [300, 299, 1])]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r["k"]: r["median"] for r in hvg.medians(df.where("k is not null"), "k", "v").collect()}
    assert found == {k: float(np.median([v for key, v in rows if key == k and v is not None])) for k in ("a", "b", "c", "d", "hot")}
    own = sorted(v for k, v in rows if k == "a" and v is not None)
    told = df.where("k = 'a'").selectExpr("k", "v", "array(1L, 7L, 7L, 41L, 99L) as w")
    assert sorted((r["place"], r["value"]) for r in hvg.order_statistics(told, "k", "v", "w").collect()) == [(1, own[0]), (7, own[6]), (41, own[40])]
    every = [v for _, v in rows if v is not None and abs(v) < 1e100]
    shares = [0.0, 0.13, 0.5, 0.77, 1.0]
    assert hvg.quantiles(df.where("abs(v) < 1e100"), "v", shares) == pytest.approx(np.quantile(every, shares).tolist(), abs=1e-12)
    plan = hvg.medians(df, "k", "v")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Percentile" not in plan


def test_percentile_flavor(spark):
    rng = np.random.default_rng(6)
    dense = np.where(rng.random((30, 40)) < 0.4, 0.0, rng.gamma(2.0, 1.0 + np.arange(40) % 7, size=(30, 40)))
    dense[:, 5], dense[:, 6] = 0, 3.0
    data = container(spark, dense)
    mean, var = dense.mean(axis=0), dense.var(axis=0, ddof=1)
    mean[mean == 0] = 1e-12
    disp = np.where(var == 0, np.nan, var / mean)
    bins = np.searchsorted(np.unique(np.percentile(mean, [20, 40, 60, 80])), mean, side="left")
    norm = np.full(40, np.nan)
    for b in set(bins):
        own = disp[bins == b]
        center = np.nanmedian(own)
        norm[bins == b] = (own - center) / (np.nanmedian(np.abs(own - center)) / 0.6744897501960817)
    params = hvg.HVGParams(flavor=hvg.Flavor.CELL_RANGER, n_bins=5, min_mean=0.0, max_mean=9.0, max_dispersion=2.0)
    rows = hvg.compute_highly_variable_genes(data, params).var.orderBy("var_id").collect()
    assert [r["bin"] for r in rows] == bins.tolist()
    assert [np.nan if r["dispersions_norm"] is None else r["dispersions_norm"] for r in rows] == pytest.approx(norm.tolist(), nan_ok=True, rel=1e-6)
    assert [r["highly_variable"] for r in rows] == [bool(0 < m < 9 and 0.5 < n < 2) for m, n in zip(mean, norm)]
    best = hvg.compute_highly_variable_genes(data, hvg.HVGParams(flavor=hvg.Flavor.CELL_RANGER, n_bins=5, n_top_genes=3, max_mean=99.0)).var.where("highly_variable").orderBy("var_id")
    assert [r["var_id"] for r in best.collect()] == sorted(np.argsort(-np.nan_to_num(norm, nan=-9))[:3].tolist())
    assert hvg.percentile(data, hvg.HVGParams(n_top_genes=0)).where("highly_variable").count() == 0


def test_extremes_of_rows_that_are_full(spark):
    """Where every entry is stored no zero counts; elsewhere one does."""
    data = container(spark, [[3.0, 2.0], [-1.0, -4.0], [5.0, 0.0], [-6.0, 0.0]])
    got = {r["obs_id"]: (r["min"], r["max"]) for r in statistics.min_max(data, Direction.ROW).collect()}
    assert got == {0: (2.0, 3.0), 1: (-4.0, -1.0), 2: (0.0, 5.0), 3: (-6.0, 0.0)}


def test_dense_rows_in_pieces_and_of_many_variables(spark):
    data = container(spark, SPARSE)
    for width in (1, 2, 5, 1 << 14):
        rows = [[] for _ in SPARSE]
        for r in selection.dense_pieces(data, width).orderBy("obs_id", "start").collect():
            assert len(rows[r["obs_id"]]) == r["start"] and len(r["row"]) <= width
            rows[r["obs_id"]] += r["row"]
        assert rows == SPARSE.tolist()
    none = container(spark, SPARSE).with_(var=data.var.limit(0), x=data.x.limit(0))
    assert selection.dense_pieces(none).count() == 0
    wide = data.with_(obs=data.obs.limit(1), var=spark.range(300_000).select(F.col("id").alias("var_id")), x=spark.createDataFrame([(0, 299_999, 2.0), (0, 7, 1.0)], "obs_id long, var_id long, value double"))
    got = _row_sums(selection.dense_pieces(wide)).collect()
    assert [tuple(r) for r in got] == [(0, 300_000, 3.0, 600_008.0, 7 * 7919 % 1009 + 2.0 * (299_999 * 7919 % 1009))]


def test_cells_of_dense_rows_are_added_up_several_a_row(spark, sf_dir):
    """A row in Spark for each cell was what densify took its time for; pieces of any length, and odd observations, have the sums of all of their cells."""
    plan = QUERIES["densify"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and f"v{CELLS - 1}" in plan
    rng = np.random.default_rng(11)
    for width in (1, CELLS - 1, CELLS, 3 * CELLS + 1, 2500):
        dense = np.where(rng.random((4, 2500)) < [[0.0], [0.001], [0.3], [1.0]], rng.integers(-9, 9, (4, 2500)) / 2, 0.0)
        data = container(spark, dense)
        more = spark.createDataFrame([(99, 0, 5.0), (None, 1, 6.0), (9, 2499, 0.5)], "obs_id long, var_id long, value double")
        data = data.with_(obs=data.obs.select("obs_id").union(spark.createDataFrame([(None,), (9,), (9,)], "obs_id long")), x=data.x.union(more))
        at, last = np.arange(2500), np.eye(1, 2500, 2499)[0] / 2
        rows = {**dict(enumerate(dense)), None: last * 0, 9: last}
        want = {k: ((1 + (k == 9)) * np.array([2500, v.sum(), (v * (at + 1)).sum(), (v * (at * 7919 % 1009)).sum()])).tolist() for k, v in rows.items()}
        assert {r["obs_id"]: list(r[1:]) for r in _row_sums(selection.dense_pieces(data, width)).collect()} == want
    single = data.with_(x=transform.convert_to_float(data.x, "single"))
    assert {r["obs_id"]: list(r[1:]) for r in _row_sums(selection.dense_pieces(single)).collect()} == want


@pytest.mark.parametrize("center", [True, False])
def test_few_observations_are_a_basis(spark, monkeypatch, center):
    """Their components come without a step, and equal those that steps find and those of a decomposition."""
    rng = np.random.default_rng(5)
    dense = np.where(rng.random((12, 40)) < 0.5, 0.0, 1.0 + rng.normal(size=(12, 40)) * 1.3 ** np.arange(12.0)[:, None])
    dense[3], dense[:, 4] = 0, 0
    options = {"center": center, "n_components": 3, "svd_method": pca.SVDMethod.RANDOMIZED}
    moved = dense - dense.mean(axis=0) if center else dense
    _, s, vt = np.linalg.svd(moved, full_matrices=False)
    vt = vt[:3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])[:, None]
    most = subspace.MOST_STEPS
    for longest, steps in ((12, 0), (11, most)):
        monkeypatch.setattr(subspace, "LONGEST", longest)
        monkeypatch.setattr(subspace, "MOST_STEPS", steps)
        found = pca.run_pca(container(spark, dense), selection.FeatureSelection(), **options)
        lines = found.variance.orderBy("component").collect()
        assert [r["explained_variance"] for r in lines] == pytest.approx((s[:3] ** 2 / 11).tolist(), rel=1e-9)
        assert [r["ratio"] for r in lines] == pytest.approx((s[:3] ** 2 / (s**2).sum()).tolist(), rel=1e-9)
        assert np.array(column(found.loadings, "var_id", "loading")) == pytest.approx(vt.T, abs=1e-6)
        assert np.array(column(found.scores, "obs_id", "score")) == pytest.approx(moved @ vt.T.copy(), abs=1e-5)


@pytest.mark.parametrize("n_top", [None, 3])
def test_percentile_flavor_reads_entries_once(spark, n_top):
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: (read.add(1), v)[1], "double").asNondeterministic()
    data = container(spark, np.random.default_rng(7).gamma(2.0, 1.0, size=(6, 20)))
    data = data.with_(x=data.x.withColumn("value", seen("value")))
    assert hvg.percentile(data, hvg.HVGParams(n_bins=3, n_top_genes=n_top, max_mean=99.0)).count() == 20
    assert read.value == 120


@pytest.mark.parametrize("reference", [None, "B"])
def test_ranks_are_found_in_tasks_of_few_variables(spark, monkeypatch, reference):
    """Tasks grow in number with the variables, and entries are dealt to them once."""
    dense, labels = three_groups()
    data = container(spark, np.round(dense), labels)
    who = diffexp.resolve(data, "segment", reference)
    want = diffexp.mann_whitney(data, who).orderBy("group", "var_id").collect()
    monkeypatch.setattr(diffexp, "VARIABLES", 3)
    found = diffexp.mann_whitney(data, who)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(var_id#\d+L, 4\), REPARTITION_BY_NUM", plan)) >= 1
    assert found.orderBy("group", "var_id").collect() == want
