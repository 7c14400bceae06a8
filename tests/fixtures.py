"""Small matrices with known answers."""

from __future__ import annotations

import numpy as np

from tesserae.plans.data import ExprData


def container(spark, dense, labels=None, names=None):
    """A container of a dense array: zeros aren't stored, ids count from 0."""
    dense = np.asarray(dense, dtype=float)
    x = [(i, j, float(v)) for i, row in enumerate(dense) for j, v in enumerate(row) if v]
    labels = labels if labels is not None else [None] * len(dense)
    names = names if names is not None else [f"gene{j}" for j in range(dense.shape[1])]
    return ExprData.from_frames(
        spark.createDataFrame(x, "obs_id long, var_id long, value double"),
        spark.createDataFrame([(i, f"c{i}", g) for i, g in enumerate(labels)], "obs_id long, obs_name string, segment string"),
        spark.createDataFrame(list(enumerate(names)), "var_id long, var_name string"),
    )


def three_groups():
    """Groups of 6, 8 and 7 observations and 10 variables, drawn by a seed; variable j is raised in group j modulo 3."""
    groups = np.repeat([0, 1, 2], [6, 8, 7])
    dense = np.random.default_rng(31).gamma(9.0, 0.2, size=(len(groups), 10))
    dense[groups[:, None] == np.arange(10) % 3] *= 4.0
    return dense, ["ABC"[g] for g in groups]
