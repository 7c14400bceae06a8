import importlib

import pytest

from tests.compare import same_rows

registry = importlib.import_module("tesserae.llm.registry")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same_rows(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
