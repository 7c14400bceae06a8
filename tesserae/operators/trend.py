"""A Gaussian-kernel ridge trend whose weights are rounds of Gauss-Seidel, over any number of rows in blocks.

A weight's update needs of all others only their sum in a space of few features, and is linear in it. So a block of
neighbouring rows is a linear system: what it adds to the sum in a sweep is what it adds from nothing, plus a matrix for each
earlier sweep times the sum that it was entered with. Blocks find these by themselves, each in a task, and the driver chains
them through all sweeps, sweep by sweep and block by block. The result is that of one loop over all rows in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sweeps and ridge of the trend.
SWEEPS, RIDGE = 100, 1.0
#: Rows of a block, and rows that are solved at once within it.
BLOCK, STEP = 16_384, 128


def scales(gamma: float) -> list[float]:
    """Factors of the features scale x^k exp(-gamma x^2), whose products are exp(-gamma (a - b)^2) for x within 0..1.

    The kernel is exp(-gamma a^2) exp(-gamma b^2) times the sum of (2 gamma a b)^k / k!, whose terms vanish fast."""
    found = [1.0]
    while found[-1] > 1e-10:
        found.append(found[-1] * math.sqrt(2.0 * gamma / len(found)))
    return found


def responses(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """What rows in order add to the sum of features, for each sweep: a column for each feature, the answer to a sum of one in it
    at the entry of the first sweep, without y; and a last column, from y and sums of zero."""
    rows = np.exp(-gamma * x * x)[:, None] * x[:, None] ** np.arange(len(scales(gamma))) * np.array(scales(gamma))
    k = rows.shape[1]
    wanted = np.zeros((len(x), k + 1))
    wanted[:, k] = y
    parts = [slice(at, at + STEP) for at in range(0, len(x), STEP)]
    solved = [np.linalg.inv(np.tril(rows[p] @ rows[p].T) + RIDGE * np.eye(len(rows[p]))) for p in parts]
    weights, found = np.zeros_like(wanted), np.empty((SWEEPS, k, k + 1))
    for sweep in range(SWEEPS):
        entered = np.eye(k, k + 1) if sweep == 0 else np.zeros((k, k + 1))
        total = entered.copy()
        for p, inverse in zip(parts, solved, strict=True):
            change = inverse @ (wanted[p] - rows[p] @ total - RIDGE * weights[p])
            weights[p] += change
            total += rows[p].T @ change
        found[sweep] = total - entered
    return found


def chain(blocks: list[np.ndarray]) -> np.ndarray:
    """The sum of features after all sweeps over blocks in order."""
    k = blocks[0].shape[1]
    total, entered = np.zeros(k), np.zeros((len(blocks), SWEEPS, k))
    for sweep in range(SWEEPS):
        for b, block in enumerate(blocks):
            entered[b, sweep] = total
            total = total + block[sweep, :, k] + np.einsum("sij,sj->i", block[sweep::-1, :, :k], entered[b, : sweep + 1])
    return total


def _block(frames: Iterator[pd.DataFrame], gamma: float) -> Iterator[pd.DataFrame]:
    held = list(frames)
    if sum(map(len, held)):
        rows = pd.concat(held, ignore_index=True)
        yield pd.DataFrame({"first": rows["key"].iloc[:1], "response": [responses(rows["x"].to_numpy(), rows["y"].to_numpy(), gamma).ravel().tolist()]})


def kernel_trend(rows: DataFrame, key: str, x: str, y: str) -> Column:
    """The trend of finite y over finite x as an expression of x; null where there are no rows. Sweeps are in the order of key.

    Rows are read three times. A block sends the driver SWEEPS matrices of its few features."""
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(x), F.max(x)).first()
    if not n:
        return F.lit(None).cast("double")
    gamma, span = 1.0 / n, high - low
    scaled = (F.col(x) - F.lit(low)) / F.lit(span) if span > 0 else F.col(x) * 0.0
    placed = rows.select(F.col(key).alias("key"), scaled.alias("x"), F.col(y).alias("y")).repartitionByRange(-(-n // BLOCK), "key").sortWithinPartitions("key")
    shape = f"first {rows.schema[key].dataType.simpleString()}, response array<double>"
    found = sorted(placed.mapInPandas(partial(_block, gamma=gamma), shape).collect())
    k = len(scales(gamma))
    total = chain([np.array(r["response"]).reshape(SWEEPS, k, k + 1) for r in found])
    value = F.lit(0.0)
    for factor in reversed(total * np.array(scales(gamma))):
        value = value * scaled + F.lit(float(factor))
    return F.exp(scaled * scaled * F.lit(-gamma)) * value
