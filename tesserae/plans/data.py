"""The container of a labelled sparse matrix: a long table of entries and a metadata table for each axis.

x holds obs_id, var_id and value; an entry that isn't stored is a real zero, so a statistic divides by the length of an
axis, which only the metadata tables know. A container is immutable: operators return a new one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Direction(Enum):
    """ROW: a result for each observation; COLUMN: a result for each variable."""

    ROW = "obs"
    COLUMN = "var"

    @property
    def key(self) -> str:
        return f"{self.value}_id"

    @property
    def other(self) -> Direction:
        return Direction.COLUMN if self is Direction.ROW else Direction.ROW


@dataclass(frozen=True)
class ExprData:
    x: DataFrame
    obs: DataFrame
    var: DataFrame
    layers: Mapping[str, DataFrame] = field(default_factory=dict)
    obsm: Mapping[str, DataFrame] = field(default_factory=dict)
    uns: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def from_frames(cls, x: DataFrame, obs: DataFrame, var: DataFrame, **more: Any) -> ExprData:
        """Entries are added up where one is stored twice, and null ones are zeros; other columns of x are dropped."""
        return cls(canonical(x), obs, var, **more)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ExprData:
        """Folders x, obs and var of Parquet, read as they are used."""
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("x", "obs", "var")))

    def write(self, path: str, mode: str = "errorifexists") -> None:
        for name in ("x", "obs", "var"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    def meta(self, direction: Direction) -> DataFrame:
        return self.obs if direction is Direction.ROW else self.var

    def length(self, direction: Direction) -> int:
        """How many results an axis has; empty rows and columns count."""
        return self.meta(direction).count()

    def persist(self) -> ExprData:
        """Keeps the entries in memory, or on disk where they don't fit."""
        return self.with_(x=self.x.persist())

    def with_(self, **parts: Any) -> ExprData:
        return replace(self, **parts)

    def annotate(self, direction: Direction, columns: DataFrame) -> ExprData:
        """Columns added to an axis by its id; those of the same name are replaced."""
        meta = self.meta(direction)
        new = [c for c in columns.columns if c != direction.key]
        joined = meta.drop(*new).join(columns, direction.key, "left")
        return self.with_(**{direction.value: joined})


def canonical(x: DataFrame) -> DataFrame:
    """One row for each entry that isn't zero, as doubles."""
    rows = x.groupBy(F.col("obs_id").cast("long").alias("obs_id"), F.col("var_id").cast("long").alias("var_id"))
    return rows.agg(F.sum(F.col("value").cast("double")).alias("value")).where("value <> 0")


def with_index(meta: DataFrame, id_col: str, name: str, block: int = 1 << 16) -> DataFrame:
    """meta with a dense ordinal from 0 in order of an integer id.

    Rows are numbered within blocks of ids, and a running sum over the blocks' counts gives where each begins; the table
    that is summed in one task has a row for each block of ids."""
    own = meta.withColumn("__block", F.floor(F.col(id_col) / F.lit(float(block))).cast("long"))
    sizes = own.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = sizes.select("__block", before.alias("__begun"))
    at = F.row_number().over(Window.partitionBy("__block").orderBy(id_col)) - 1
    return own.withColumn("__at", at).join(begun, "__block").withColumn(name, (F.col("__begun") + F.col("__at")).cast("long")).drop("__block", "__at", "__begun")
