"""What plans must and must not hold, whatever the size of the input."""

import re

import pytest

from tesserae.plans.registry import queries

#: Queries that have a Python part by design.
PYTHON = {"de_pvalues", "rank_gene_groups", "rank_gene_groups_stored", "pca_scores", "pca_variance", "pca_loadings"}
#: Those of this round: null distributions of U are counted, and local regressions are fitted, in tasks.
PYTHON |= {"de_mannwhitney_exact", "de_mannwhitney_exact_reference", "rank_gene_groups_exact", "hvg_loess", "hvg_loess_batches"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - {"pca_variance", "pca_loadings"}))
def test_no_products_and_no_python(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert (name in PYTHON) or not re.search("Python|Pandas|InArrow", text)


@pytest.mark.parametrize("name", ["qc_obs", "var_variance", "de_welch_stat", "filter_genes"])
def test_only_needed_columns_are_read(spark, sf_dir, name):
    scans = re.findall(r"lineitem\.parquet.*?ReadSchema: struct<([^>]*)>", plan(queries()[name](spark, sf_dir)))
    assert scans
    for columns in scans:
        assert {c.split(":")[0] for c in columns.split(",")} <= {"l_orderkey", "l_partkey", "l_quantity"}


def test_observation_metrics_shuffle_entries_once(spark, sf_dir):
    """Two shuffles make the matrix from its tables, one deals entries to observations, and one is of the result."""
    text = plan(queries()["qc_obs"](spark, sf_dir))
    assert len(re.findall("Exchange hashpartitioning", text)) <= 7


def test_a_selection_is_a_semi_join(spark, sf_dir):
    assert "LeftSemi" in plan(queries()["select_obs"](spark, sf_dir))
