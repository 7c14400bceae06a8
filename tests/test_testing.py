"""Tests of groups against plain calculations and the fixture's known values."""

import itertools
import math
import random

import numpy as np
import pytest

from tesserae.functions import special
from tesserae.functions.corrections import Correction, apply_correction
from tesserae.operators import diffexp
from tesserae.plans.data import ExprData
from tests.fixtures import container, three_groups


def brute_u(a, b):
    u = sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b))
    n, m = len(a), len(b)
    every = np.concatenate([a, b])
    ties = sum(t**3 - t for t in np.unique(every, return_counts=True)[1])
    total = n + m
    sd2 = n * m / 12 * (total + 1 - ties / (total * (total - 1)))
    off = u - n * m / 2
    return u, (math.copysign(1, off) * max(abs(off) - 0.5, 0) / math.sqrt(sd2) if sd2 > 0 and off else 0.0)


@pytest.mark.parametrize("reference", [None, "B"])
def test_ranks_with_zeros_negatives_ties_and_null_labels(spark, reference):
    rng = np.random.default_rng(11)
    dense = rng.integers(-2, 3, size=(24, 7)).astype(float)
    dense[:, 3] = 0
    labels = [None if i % 7 == 0 else "ABC"[i % 3] for i in range(24)]
    data = container(spark, dense, labels)
    found = {(r["group"], r["var_id"]): (r["u"], r["z"]) for r in diffexp.mann_whitney(data, diffexp.resolve(data, "segment", reference)).collect()}
    assert len(found) == 21
    for group, j in found:
        own = dense[[i for i, g in enumerate(labels) if g == group], j]
        rest = dense[[i for i, g in enumerate(labels) if (g != group if reference is None else g == reference)], j]
        assert found[group, j] == pytest.approx(brute_u(own, rest)), (group, j)


def test_t_statistics_and_p_values(spark):
    dense, labels = three_groups()
    dense[:, 9] = 0
    data = container(spark, dense, labels)
    for method in (diffexp.TestMethod.WELCH, diffexp.TestMethod.STUDENT):
        who = diffexp.resolve(data, "segment", "B", ["A"])
        rows = diffexp.t_statistics(diffexp.group_sums(data, who), method).orderBy("var_id").collect()
        for j, r in enumerate(rows[:9]):
            a, b = dense[:6, j], dense[6:14, j]
            v, w = a.var(ddof=1), b.var(ddof=1)
            if method is diffexp.TestMethod.WELCH:
                se, df = math.sqrt(v / 6 + w / 8), (v / 6 + w / 8) ** 2 / ((v / 6) ** 2 / 5 + (w / 8) ** 2 / 7)
            else:
                se, df = math.sqrt((5 * v + 7 * w) / 12 * (1 / 6 + 1 / 8)), 12
            assert r["t"] == pytest.approx((a.mean() - b.mean()) / se, rel=1e-6)
            assert r["df"] == pytest.approx(df, rel=1e-6)
        assert rows[9]["t"] == 0.0


def test_tails():
    assert special.student_two_sided(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.07338803477074037)
    # Two degrees of freedom have a closed form.
    for t in (0.1, 1.0, 7.5, 400.0):
        assert special.student_two_sided(np.array([t]), np.array([2.0]))[0] == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-6)
    assert special.student_two_sided(np.array([0.0, np.inf]), np.array([5.0, 5.0])).tolist() == [1.0, 0.0]
    assert np.isnan(special.student_two_sided(np.array([np.nan]), np.array([5.0])))[0]
    assert special.normal_two_sided(np.array([1.959963984540054]))[0] == pytest.approx(0.05)


def test_arguments(spark):
    dense, labels = three_groups()
    data = container(spark, dense, labels)
    with pytest.raises(ValueError):
        diffexp.rank_gene_groups_dataframe(data, "segment", groups=["Z"])
    with pytest.raises(ValueError):
        diffexp.rank_gene_groups_dataframe(data, "segment", reference="Z")
    with pytest.raises(ValueError):
        diffexp.rank_gene_groups_dataframe(data, "segment", method="other")
    with pytest.raises(ValueError):
        diffexp.obs_of_group(data, "segment", "Z")
    assert diffexp.rank_gene_groups_dataframe(data, "segment", n_genes=0).count() == 0
    same = diffexp.rank_gene_groups_dataframe(data, "segment", reference="A", groups=["A"], n_genes=2).collect()
    assert [r["score"] for r in same] == [0.0, 0.0] and all(r["pval"] == pytest.approx(1.0) for r in same)


def test_labels_of_integers(spark):
    from pyspark.sql import functions as F

    dense, labels = three_groups()
    data = container(spark, dense, labels)
    data = data.with_(obs=data.obs.withColumn("n", F.ascii("segment").cast("int") - 64))
    assert diffexp.resolve(data, "n").names == ["1", "2", "3"]


def plain_correction(p, method):
    order = sorted(range(len(p)), key=lambda i: p[i])
    m, out = len(p), [0.0] * len(p)
    if method is Correction.BONFERRONI:
        return [min(1, m * v) for v in p]
    scale = {Correction.BENJAMINI_YEKUTIELI: sum(1 / k for k in range(1, m + 1)), Correction.STOREY: min(1, sum(v > 0.5 for v in p) / (m * 0.5))}.get(method, 1.0)
    last = 0.0 if method is Correction.HOLM else math.inf
    for rank in range(m) if method is Correction.HOLM else reversed(range(m)):
        v = p[order[rank]]
        own = (m - rank) * v if method in (Correction.HOLM, Correction.HOCHBERG) else m * v / (rank + 1)
        last = max(last, own) if method is Correction.HOLM else min(last, own)
        out[order[rank]] = min(1, last * scale)
    return out


@pytest.mark.parametrize("method", list(Correction))
@pytest.mark.parametrize("p", [[0.3], [0.0, 0.01, 0.01, 0.02, 0.5, 0.9, 1.0, 1.0, 0.04]])
def test_corrections(spark, method, p):
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate(p)] + [("g", 99, None)], "g string, i long, p double")
    found = apply_correction(rows, "g", "p", "i", method).orderBy("i").collect()
    assert [r["pval_adj"] for r in found[:-1]] == pytest.approx(plain_correction(p, method))
    assert found[-1]["pval_adj"] is None


def chances(mine, others):
    """u and twice the smaller tail over every choice of as many of all values."""
    both = mine + others

    def u(of):
        rest = [i for i in range(len(both)) if i not in of]
        return sum((both[i] > both[j]) + (both[i] == both[j]) / 2 for i in of for j in rest)

    own = u(range(len(mine)))
    every = [u(c) for c in itertools.combinations(range(len(both)), len(mine))]
    return own, min(1.0, 2 * min(sum(v <= own for v in every), sum(v >= own for v in every)) / len(every))


@pytest.mark.parametrize("reference", [None, "b"])
def test_exact_p_is_that_of_all_choices(spark, reference):
    rng = random.Random(1)
    labels = ["a"] * 4 + ["b"] * 3 + ["c"] + [None] * 2
    values = {v: [rng.choice([0, 0, -1.5, 1, 2, 2.5, 7]) if v else 0 for _ in labels] for v in range(12)}
    x = spark.createDataFrame([(i, v, float(row[i])) for v, row in values.items() for i in range(len(labels)) if row[i] or (i + v) % 4 == 0], "obs_id long, var_id long, value double")
    data = ExprData.from_frames(x, spark.createDataFrame(list(enumerate(labels)), "obs_id long, label string"), spark.range(12).withColumnRenamed("id", "var_id"))
    rows = diffexp.mann_whitney_p(data, diffexp.resolve(data, "label", reference), 21).collect()
    assert len(rows) == 36
    for r in rows:
        own = [values[r["var_id"]][i] for i, k in enumerate(labels) if k == r["group"]]
        rest = [values[r["var_id"]][i] for i, k in enumerate(labels) if (k != r["group"] if reference is None else k == reference)]
        if reference == r["group"]:
            assert not r["exact"]
        elif len(own) * len(rest) <= 21:
            assert r["exact"] and (r["u"], pytest.approx(r["pval"], abs=1e-12)) == chances(own, rest)
        else:
            assert not r["exact"]
    assert {r["group"] for r in rows if r["exact"]} == ({"b", "c"} if reference is None else {"a", "c"})


def test_exact_p_counts_the_smaller_side():
    rng = random.Random(2)
    for _ in range(30):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        both = [rng.randrange(4) for _ in range(n + m)]
        blocks = tuple(both.count(v) for v in sorted(set(both)))
        u, p = chances(both[:n], both[n:])
        assert special.exact_two_sided(n, m, u, blocks) == pytest.approx(p, abs=1e-12)
        assert special.exact_two_sided(m, n, n * m - u, blocks) == pytest.approx(p, abs=1e-12)
    # Without ties, the least u of five against five has two of the 252 choices at its ends.
    assert special.exact_two_sided(5, 5, 0.0, (1,) * 10) == pytest.approx(2 / 252)


def test_large_groups_keep_the_normal_form(spark):
    data = container(spark, *three_groups())
    who = diffexp.resolve(data, "segment")
    rows = diffexp.mann_whitney_p(data, who, 89).collect()
    assert not any(r["exact"] for r in rows)
    assert all(r["pval"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2))) for r in rows)
    assert all(r["exact"] for r in diffexp.mann_whitney_p(data, who, 104).collect())


@pytest.mark.parametrize("method", list(Correction))
def test_split_corrections_are_those_of_whole_families(spark, method):
    rng = random.Random(9)
    rows = [(g, i, rng.choice([0.0, 1.0, 1e-300, 0.05, rng.random(), rng.random() ** 9, None])) for i, g in enumerate(["a"] * 150 + ["b"] * 70 + [None] * 40 + ["c"])]
    tests = spark.createDataFrame(rows, "g string, i long, p double").selectExpr("*", "0 as m", "'x' as band")
    split = apply_correction(tests, "g", "p", "i", method, split=True)
    whole = apply_correction(tests, "g", "p", "i", method)
    assert split.columns == whole.columns
    got, want = ({r["i"]: r["pval_adj"] for r in df.collect()} for df in (split, whole))
    assert len(got) == len(rows) and got.keys() == want.keys()
    assert all((got[i] is None) == (want[i] is None) and (want[i] is None or got[i] == pytest.approx(want[i], rel=1e-12)) for i in want)
    # Values are put in order within bands only.
    windows = [line for line in split._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and all("[p#" not in line or "band#" in line for line in windows)
