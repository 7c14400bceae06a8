"""The ten-by-twelve fixture with its known results: group A against B, by Welch's test."""

import numpy as np
import pytest

from tesserae.operators import diffexp
from tests.fixtures import container, three_groups

#: Rows are observations c1..c10, five of A and five of B.
VALUES = [
    [10.0, 10.2, 9.8, 10.5, 10.3, 9.7, 1.0, 1.2, 0.8, 1.1, 0.9, 1.3],
    [12.0, 11.8, 12.2, 11.5, 12.5, 11.7, 1.5, 1.7, 1.3, 1.6, 1.4, 1.8],
    [11.0, 11.3, 10.7, 11.2, 10.8, 11.4, 1.2, 1.1, 1.3, 0.9, 1.4, 1.0],
    [1.5, 1.3, 1.7, 1.4, 1.8, 1.2, 8.0, 8.2, 7.8, 8.5, 7.7, 8.3],
    [1.8, 1.6, 2.0, 1.5, 1.9, 1.7, 9.0, 8.8, 9.2, 8.7, 9.3, 8.9],
    [1.2, 1.4, 1.0, 1.3, 0.9, 1.1, 7.5, 7.7, 7.3, 7.8, 7.2, 7.9],
    [5.0, 5.2, 4.8, 5.1, 4.9, 5.3, 5.1, 4.9, 5.3, 4.7, 5.2, 5.0],
    [4.7, 4.5, 4.9, 4.6, 5.0, 4.8, 4.8, 5.0, 4.6, 4.9, 4.7, 5.1],
    [5.2, 5.0, 5.4, 4.8, 5.3, 5.1, 5.0, 5.2, 4.8, 5.3, 4.9, 5.1],
    [3.0, 3.2, 2.8, 3.1, 2.9, 3.3, 3.2, 2.8, 3.4, 2.9, 3.3, 3.1],
]
#: T, df, p, adjusted p, log2 fold change and U of each variable.
WANT = [
    (1.412877, 4.8582, 0.218435, 0.503301, 4.962871, 17),
    (1.362261, 4.7011, 0.234746, 0.503301, 4.876309, 16),
    (1.460388, 5.0559, 0.203387, 0.503301, 5.049433, 17),
    (1.395242, 4.7165, 0.225073, 0.503301, 4.962871, 17),
    (1.483765, 5.0323, 0.197622, 0.503301, 5.280264, 17),
    (1.299592, 4.8881, 0.251651, 0.503301, 4.645478, 17),
    (-0.511347, 5.1583, 0.630240, 0.651121, -1.413841, 10),
    (-0.477872, 5.5045, 0.651121, 0.651121, -1.327279, 10),
    (-0.518559, 4.9644, 0.626344, 0.651121, -1.442695, 10),
    (-0.484997, 5.4485, 0.646555, 0.651121, -1.384987, 10),
    (-0.482662, 4.9552, 0.649903, 0.651121, -1.327279, 10),
    (-0.505921, 5.4359, 0.632761, 0.651121, -1.413841, 10),
]
ORDER = [4, 2, 0, 3, 1, 5, 8, 6, 11, 9, 10, 7]


@pytest.fixture(scope="module")
def data(spark):
    return container(spark, np.array(VALUES), ["A"] * 5 + ["B"] * 5)


def test_statistics(data):
    who = diffexp.resolve(data, "segment", "B", ["A"])
    rows = diffexp.log_fold_change(diffexp.t_statistics(diffexp.group_sums(data, who), diffexp.TestMethod.WELCH)).orderBy("var_id").collect()
    for r, (t, df, _, _, change, _) in zip(rows, WANT, strict=True):
        assert (r["t"], r["logfoldchange"]) == pytest.approx((t, change), abs=1e-5) and r["df"] == pytest.approx(df, abs=1e-3)
    assert [r["u"] for r in diffexp.mann_whitney(data, who).orderBy("var_id").collect()] == [w[5] for w in WANT]


def test_ranking(data):
    rows = diffexp.rank_gene_groups_dataframe(data, "segment", "B", ["A"]).orderBy("rank").collect()
    assert [int(r["gene"].removeprefix("gene")) for r in rows] == ORDER
    for r, j in zip(rows, ORDER, strict=True):
        assert (r["pval"], r["pval_adj"]) == pytest.approx(WANT[j][2:4], abs=1e-5)


@pytest.mark.parametrize(
    "options",
    [
        {"groups": ["C", "A"], "reference": "B", "n_genes": 4, "key_added": "pairs"},
        {"method": diffexp.TestMethod.MANN_WHITNEY, "correction": diffexp.Correction.HOLM, "n_genes": 2},
        {"method": diffexp.TestMethod.STUDENT, "compute_logfoldchanges": False},
    ],
)
def test_stored_results_are_those_of_the_long_rows(spark, options):
    """Each wide table has a group's column of the long rows, in order of rank."""
    dense, labels = three_groups()
    data = container(spark, dense, labels)
    uns = diffexp.rank_gene_groups(data, "segment", **options).uns
    base = f"rank_genes_groups_{options['key_added']}_" if "key_added" in options else "rank_genes_groups_"
    rows = diffexp.rank_gene_groups_dataframe(data, "segment", **{k: v for k, v in options.items() if k != "key_added"}).orderBy("rank").toPandas()
    for name, column in {"scores": "score", "pvals": "pval", "pvals_adj": "pval_adj", "logfoldchanges": "logfoldchange", "names": "gene"}.items():
        wide = uns[base + name].orderBy("rank").toPandas()
        assert wide.columns.tolist() == ["rank", *options.get("groups", ["A", "B", "C"])]
        for group in wide.columns[1:]:
            got, want = wide[group].tolist(), rows.loc[rows["group"] == group, column].tolist()
            # Two runs may add doubles in another order.
            assert got == want if name == "names" else got == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert uns[base + "params_reference"] == options.get("reference", "rest") and uns[base + "params_groupby"] == "segment"
    assert uns[base + "params_method"] == options.get("method", diffexp.TestMethod.WELCH).value
