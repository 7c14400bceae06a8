"""Names of columns: of any input column, whatever its characters, and of own columns that no input column has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The top-level column of that name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(taken: Iterable[str], name: str) -> str:
    """name, or name_1 and so on where a column is called so; as Spark does, upper and lower case count as the same."""
    used = {t.lower() for t in taken}
    found, n = name, 0
    while found.lower() in used:
        n += 1
        found = f"{name}_{n}"
    return found
