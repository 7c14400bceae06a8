"""Principal components of a sparse matrix over chosen variables.

The Gram matrix of the chosen variables is added up from blocks of observations, so what is moved grows with blocks and the
square of the variables, not with observations; its eigenvectors are found on the driver, which bounds the variables. More
variables than that go by a block Krylov space (`subspace.py`), whose tables are distributed on both axes, to a tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.selection import FeatureSelection, Method, select_features
from tesserae.operators.subspace import SPREAD, leading_components, sum_lines
from tesserae.plans.data import Direction, ExprData

#: Most variables of a Gram matrix, observations of a block, and lines of a batch.
MOST, BLOCK, LINES = 5000, 4096, 256


class SVDMethod(Enum):
    """GRAM has at most MOST variables; RANDOMIZED has any number, begins at random and ends where components are found to a tolerance."""

    GRAM = "gram"
    RANDOMIZED = "randomized"


@dataclass(frozen=True)
class PCAResult:
    """scores: obs_id and an array; variance: component, explained_variance, ratio and cumulative; loadings: var_id and an array, signed so that each component's largest one is positive."""

    scores: DataFrame
    variance: DataFrame
    loadings: DataFrame


def _blocks(data: ExprData, places: dict[int, int], n_obs: int) -> DataFrame:
    """block, obs_id, at and value of the entries of the chosen variables; a block holds all entries of its observations."""
    n = max(1, -(-n_obs // BLOCK))
    names = data.x.sparkSession.createDataFrame(list(places.items()), "var_id long, at int")  # at most MOST rows
    return data.x.join(F.broadcast(names), "var_id").select(F.pmod(F.xxhash64("obs_id"), F.lit(n)).alias("block"), "obs_id", "at", F.col("value").cast("double").alias("value"))


def _dense(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids, row = np.unique(rows.column("obs_id").to_numpy(), return_inverse=True)
    out = np.zeros((len(ids), width))
    np.add.at(out, (row, rows.column("at").to_numpy()), rows.column("value").to_numpy())
    return ids, out


def gram(blocks: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of products of each pair of variables, and the sum of each.

    Observations are dealt by block; a task adds up all of its blocks and emits one line for each variable at its end, and the
    lines of all tasks are added up in two steps, SPREAD tasks a line first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, last = np.zeros((width + 1, width)), [], None

        def add() -> None:
            _, x = _dense(pa.Table.from_batches(held), width)
            total[:-1] += x.T @ x
            total[-1] += x.sum(axis=0)

        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if held and block[i] != last:
                    add()
                    held = []
                held.append(batch.slice(i, j - i))
                last = block[i]
        if held:
            add()
            for i in range(0, width + 1, LINES):
                some = total[i : i + LINES]
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * width, pa.int32()), pa.array(some.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(some)), pa.int32()), sums], ["line", "sums"])

    ordered = blocks.repartition("block").sortWithinPartitions("block", "obs_id")
    lines = ordered.mapInArrow(part, "line int, sums array<double>").withColumn("task", F.spark_partition_id() % SPREAD)
    found = sum_lines(sum_lines(lines, ["line", "task"]), ["line"]).collect()  # width + 1 lines of width numbers
    out = np.zeros((width + 1, width))
    for r in found:
        out[r["line"]] = r["sums"]
    return out[:-1], out[-1]


def _variance(data: ExprData, lines: list[tuple[float, float]], n_obs: int) -> DataFrame:
    """A line for each component from its eigenvalue and share of the whole."""
    shares = np.cumsum([share for _, share in lines])
    rows = [(i, value / max(1, n_obs - 1), share, float(c)) for i, ((value, share), c) in enumerate(zip(lines, shares, strict=True))]
    return data.x.sparkSession.createDataFrame(rows, "component int, explained_variance double, ratio double, cumulative double")


def run_pca(
    data: ExprData,
    selection: FeatureSelection | None = None,
    center: bool = False,
    n_components: int = 50,
    seed: int = 42,
    svd_method: SVDMethod | None = None,
    alpha: float = 1.0,
    verbose: bool = False,
) -> PCAResult:
    """Components of the chosen variables, by default 1000 at random and without centering.

    There are at most as many components as variables or observations, and by RANDOMIZED at most as many as the rank. Explained
    variance is a component's eigenvalue over n - 1, and its ratio is to the sum over all components. Without a method, it is
    GRAM for up to MOST variables and else RANDOMIZED. alpha and verbose are accepted and have no effect."""
    if selection is None:
        selection = FeatureSelection(Method.RANDOM, count=1000, seed=seed)
    features = select_features(data, selection).select("var_id")
    ids = sorted(r["var_id"] for r in features.limit(MOST + 1).collect())
    if not ids:
        raise ValueError("no variable is chosen")
    if svd_method is SVDMethod.RANDOMIZED or (svd_method is None and len(ids) > MOST):
        n_obs = data.length(Direction.ROW)
        scores, lines, loadings = leading_components(data.x.join(features, "var_id", "left_semi"), data.obs, features, n_obs, features.count(), center, n_components, seed)
        return PCAResult(scores, _variance(data, lines, n_obs), loadings)
    if len(ids) > MOST:
        raise ValueError(f"{svd_method} takes at most {MOST} variables")
    width, n_obs = len(ids), data.length(Direction.ROW)
    blocks = _blocks(data, {v: i for i, v in enumerate(ids)}, n_obs)
    products, sums = gram(blocks, width)
    mean = sums / max(1, n_obs) if center else np.zeros(width)
    scatter = products - n_obs * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    k = min(n_components, width, max(1, n_obs))
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), np.arange(k)] + 1e-300)
    offset = mean @ vectors

    def project(key: tuple, rows: pa.Table) -> pa.Table:
        own, x = _dense(rows, width)
        return pa.table({"obs_id": own, "score": pa.array(list(x @ vectors - offset), pa.list_(pa.float64()))})

    found = blocks.groupBy("block").applyInArrow(project, "obs_id long, score array<double>")
    nothing = F.array(*(F.lit(float(v)) for v in -offset))
    scores = data.obs.select("obs_id").join(found, "obs_id", "left").select("obs_id", F.coalesce("score", nothing).alias("score"))
    total = values.sum()
    variance = _variance(data, [(float(v), float(v / total) if total > 0 else 0.0) for v in values[:k]], n_obs)
    loadings = data.x.sparkSession.createDataFrame([(int(v), [float(w) for w in row]) for v, row in zip(ids, vectors, strict=True)], "var_id long, loading array<double>")
    return PCAResult(scores, variance, loadings)
