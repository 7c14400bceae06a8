"""Local regressions and their batches, against fits of every variable on its own."""

import numpy as np
import pytest

from tesserae.operators import hvg, loess
from tests.fixtures import container


def plain_fit(x, y, span):
    near = int(max(1, min(len(x), np.floor(span * len(x) + 1e-5))))
    out = []
    for at in x:
        d = np.abs(x - at)
        h = np.sort(d)[near - 1]
        inside = d < h
        if len(set(x[inside])) < 4:
            out.append(y[d == 0].mean())
        else:
            w = (1 - (d[inside] / h) ** 3) ** 3
            out.append(np.polyfit((x[inside] - at) / h, y[inside], 2, w=np.sqrt(w))[-1])
    return np.array(out)


def plain_norms(dense, span):
    n, mean = len(dense), dense.mean(axis=0)
    out = np.full(dense.shape[1], np.nan)
    if n < 2:
        return out
    variance = dense.var(axis=0, ddof=1)
    own = np.flatnonzero((mean > 0) & (variance > 1e-12 * mean**2))
    if len(own):
        fit = plain_fit(np.round(np.log10(mean[own]), 9), np.round(np.log10(variance[own]), 9), span)
        sd = np.sqrt(10.0**fit)
        cut = np.minimum(dense[:, own], mean[own] + sd * np.sqrt(n))
        out[own] = ((cut - mean[own]) ** 2).sum(axis=0) / ((n - 1) * sd**2)
    return out


def counts(seed, n=60, variables=90):
    rng = np.random.default_rng(seed)
    dense = rng.poisson(rng.gamma(1.0, 4.0, variables) * rng.gamma(2.0, 0.5, (n, 1)), (n, variables)).astype(float)
    dense[:, 5] = dense[:, 6] = dense[:, 7]
    dense[:, 8], dense[:, 9], dense[0, 10] = 0.0, 3.0, 500.0
    dense[:, 11] -= 2.0
    return dense


@pytest.mark.parametrize(("block", "span"), [(7, 0.3), (1024, 0.3), (16, 1.0), (16, 0.02), (5, 3.0)])
def test_fits_in_blocks_equal_fits_one_by_one(spark, monkeypatch, block, span):
    monkeypatch.setattr(loess, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(size=70), np.full(40, 0.25), rng.integers(0, 4, 30) / 2.0]), 9)
    y = np.sin(x) + 0.1 * rng.normal(size=len(x))
    rows = [("b" if i % 3 else "a", i, 9, 1.0, float(x[i]), float(y[i])) for i in range(len(x))]
    got = {(r["batch"], r["var_id"]): r["trend"] for r in loess.fitted(spark.createDataFrame(rows, "batch string, var_id long, n long, mean double, x double, y double"), span).collect()}
    assert len(got) == len(x)
    for batch in "ab":
        own = [i for i in range(len(x)) if ("b" if i % 3 else "a") == batch]
        assert [got[batch, i] for i in own] == pytest.approx(plain_fit(x[own], y[own], span).tolist(), abs=1e-8)


def test_places_and_no_batch_in_one_task(spark):
    rows = [("ab"[i % 2], i, float(i * 37 % 11) - 5) for i in range(200)]
    df = spark.createDataFrame(rows, "batch string, var_id long, v double")
    got = {r["var_id"]: r["place"] for r in loess.places(df, df["v"], "place").collect()}
    for batch in "ab":
        own = sorted((v, i) for b, i, v in rows if b == batch)
        assert [got[i] for _, i in own] == list(range(100))


def test_variables_of_batches(spark, monkeypatch):
    monkeypatch.setattr(loess, "BLOCK", 16)
    dense = counts(1)
    labels = ["a" if i < 20 else "b" if i < 45 else "one" if i == 45 else None for i in range(60)]
    data = container(spark, dense)
    named = spark.createDataFrame(list(enumerate(labels)), "obs_id long, lab string")
    data = data.with_(obs=data.obs.join(named, "obs_id", "left"))
    params = hvg.HVGParams(flavor=hvg.Flavor.LOESS, batch_key="lab", n_top_genes=12, span=0.4)
    rows = hvg.compute_highly_variable_genes(data, params).var.orderBy("var_id").collect()
    norms = [plain_norms(dense[[i for i, own in enumerate(labels) if own == b]], 0.4) for b in ("a", "b", "one")]
    places = {v: [] for v in range(90)}
    for norm in norms:
        order = sorted(np.flatnonzero(~np.isnan(norm)).tolist(), key=lambda v: (-round(norm[v], 9), v))
        for place, v in enumerate(order[:12]):
            places[v].append(place)
    best = sorted((v for v in places if places[v]), key=lambda v: (np.median(places[v]), -len(places[v]), v))[:12]
    assert [r["variances_norm"] for r in rows] == pytest.approx((np.nan_to_num(norms).sum(axis=0) / 3).tolist(), abs=1e-7)
    assert [r["highly_variable_nbatches"] for r in rows] == [len(places[v]) for v in range(90)]
    assert [r["highly_variable_rank"] for r in rows] == [np.median(places[v]) if places[v] else None for v in range(90)]
    assert [r["var_id"] for r in rows if r["highly_variable"]] == sorted(best)


def test_variables_without_batches_and_odd_tables(spark):
    dense = counts(2)
    data = container(spark, dense)
    rows = hvg.loess(data, hvg.HVGParams(flavor=hvg.Flavor.LOESS, min_dispersion=1.1, max_mean=50.0)).orderBy("var_id").collect()
    norm = np.nan_to_num(plain_norms(dense, 0.3))
    assert [r["variances_norm"] for r in rows] == pytest.approx(norm.tolist(), abs=1e-7)
    mean = dense.mean(axis=0)
    assert [r["highly_variable"] for r in rows] == [bool(a > 1.1 and 0.0125 < m < 50) for a, m in zip(norm, mean, strict=True)]
    assert not any(r["highly_variable"] for r in hvg.loess(data, hvg.HVGParams(n_top_genes=0)).collect())
    empty = hvg.loess(container(spark, np.zeros((4, 3))), hvg.HVGParams(n_top_genes=2)).collect()
    assert [(r["variances_norm"], r["highly_variable_nbatches"], r["highly_variable_rank"], r["highly_variable"]) for r in empty] == [(0.0, 0, None, False)] * 3
    with pytest.raises(ValueError):
        hvg.loess(data, hvg.HVGParams(span=0.0))


def points_of(spark, batches, x, y):
    return spark.createDataFrame([(b, i, 9, 1.0, float(v), float(w)) for i, (b, v, w) in enumerate(zip(batches, x, y, strict=True))], "batch string, var_id long, n long, mean double, x double, y double")


def test_variables_of_the_same_mean_are_fitted_once(spark, monkeypatch):
    """Rows that tasks are sent grow with the different means, and not with variables times blocks of them."""
    sent, fitted = spark.sparkContext.accumulator(0), loess.local_fits
    monkeypatch.setattr(loess, "local_fits", lambda x, *more: (sent.add(len(x)), fitted(x, *more))[1])
    monkeypatch.setattr(loess, "BLOCK", 8)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 30, 3000) / 8.0
    y = np.cos(x) + 0.1 * rng.normal(size=len(x))
    got = {r["var_id"]: r["trend"] for r in loess.fitted(points_of(spark, [""] * len(x), x, y), 0.5).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(plain_fit(x, y, 0.5).tolist(), abs=1e-8)
    assert 0 < sent.value <= 30 * 4


def test_a_value_goes_to_few_blocks_of_its_batch(spark, monkeypatch):
    """With more values than BLOCKS blocks of BLOCK hold, blocks are longer, each batch by itself."""
    sent, fitted = spark.sparkContext.accumulator(0), loess.local_fits
    monkeypatch.setattr(loess, "local_fits", lambda x, *more: (sent.add(len(x)), fitted(x, *more))[1])
    monkeypatch.setattr(loess, "BLOCK", 4)
    monkeypatch.setattr(loess, "BLOCKS", 5, raising=False)
    rng = np.random.default_rng(9)
    x, names = np.round(rng.normal(size=400), 9), np.array(["ab"[i % 5 == 0] for i in range(400)])
    y = x**2 + 0.1 * rng.normal(size=len(x))
    got = {r["var_id"]: r["trend"] for r in loess.fitted(points_of(spark, names.tolist(), x, y), 0.3).collect()}
    for batch in "ab":
        own = np.flatnonzero(names == batch)
        assert [got[i] for i in own.tolist()] == pytest.approx(plain_fit(x[own], y[own], 0.3).tolist(), abs=1e-8)
    assert 0 < sent.value <= 400 * 5


def named_batches(spark, dense, labels):
    data = container(spark, dense)
    return data.with_(obs=data.obs.join(spark.createDataFrame(list(enumerate(labels)), "obs_id long, lab string"), "obs_id", "left"))


def test_entries_are_read_once_where_one_value_is_clipped_at_most(spark):
    """Moments over all observations, those of batches and clipped variances come from one pass."""
    rng = np.random.default_rng(6)
    dense, labels = rng.poisson(5.0, (60, 40)).astype(float), ["a" if i < 25 else "b" if i < 55 else None for i in range(60)]
    dense[30, 3], dense[57, 4] = 400.0, 90.0
    data, read = named_batches(spark, dense, labels), spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            read.add(part.num_rows)
            yield part

    data = data.with_(x=data.x.mapInArrow(seen, data.x.schema))
    rows = hvg.loess(data, hvg.HVGParams(batch_key="lab", n_top_genes=5, span=0.5)).orderBy("var_id").collect()
    assert read.value == np.count_nonzero(dense)
    norms = [plain_norms(dense[[i for i, own in enumerate(labels) if own == b]], 0.5) for b in "ab"]
    assert [r["variances_norm"] for r in rows] == pytest.approx(np.nan_to_num(norms).mean(axis=0).tolist(), abs=1e-7)
    assert [r["means"] for r in rows] == pytest.approx(dense.mean(axis=0).tolist())
    assert [r["variances"] for r in rows] == pytest.approx(dense.var(axis=0, ddof=1).tolist())


@pytest.mark.parametrize("few", [100_000, 0])
def test_variables_with_more_clipped_values_or_small_deviations(spark, monkeypatch, few):
    """Their entries are read again, whether they are few or not; sums of squares don't have the digits of a variance by far below the mean."""
    monkeypatch.setattr(loess, "FEW", few, raising=False)
    rng = np.random.default_rng(8)
    dense, labels = rng.poisson(5.0, (80, 40)).astype(float), ["a" if i < 35 else "b" for i in range(80)]
    dense[[3, 40, 41, 42], 3], dense[[1, 2], 5], dense[[50, 60], 6], dense[:, 7] = 300.0, [200.0, 90.0], -400.0, 1e3 + rng.normal(size=80)
    norms = [plain_norms(dense[[i for i, own in enumerate(labels) if own == b]], 0.5) for b in "ab"]
    for more in ({"n_top_genes": 3}, {"min_dispersion": 1.0, "max_mean": 1e9}):
        rows = hvg.loess(named_batches(spark, dense, labels), hvg.HVGParams(batch_key="lab", span=0.5, **more)).orderBy("var_id").collect()
        assert [r["variances_norm"] for r in rows] == pytest.approx(np.nan_to_num(norms).mean(axis=0).tolist(), abs=1e-6)
        hits = [np.argsort(-norm, kind="stable")[:3] if "n_top_genes" in more else np.flatnonzero(norm > 1.0) for norm in norms]
        assert [r["highly_variable_nbatches"] for r in rows] == [sum(v in hit for hit in hits) for v in range(40)]
