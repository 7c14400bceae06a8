"""Every query of the library by name, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from tesserae.plans.oracles import ORACLES
from tesserae.plans.queries import QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
