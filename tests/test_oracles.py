import importlib

import pytest

from tests.compare import same_rows

registry = importlib.import_module("tesserae.plans.registry")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same_rows(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 150
    assert set(registry.queries()) <= set(entry.queries())
