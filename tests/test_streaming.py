"""Statistics over streams: after each batch they equal those of all entries so far."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import statistics
from tesserae.plans.data import Direction, ExprData
from tesserae.streaming.statistics import running_moments, running_n_top

SCHEMA = "obs_id long, var_id long, value double"
ROWS, COLUMNS, CHUNKS = 12, 7, 3


def matrix():
    rng = np.random.default_rng(8)
    dense = np.where(rng.random((ROWS, COLUMNS)) < 0.5, np.round(rng.normal(0, 5, (ROWS, COLUMNS)), 2), 0.0)
    dense[:, 0] = np.arange(ROWS) + 1e6  # full, far from zero
    dense[:, 1] = 0.0
    dense[:, 2] = -np.abs(dense[:, 2]) - 1.0  # full and below zero
    return dense


@pytest.fixture
def chunks(spark, tmp_path):
    """Entries by chunks of observations, each a file of a stream; and the container of the entries up to each."""
    dense, source = matrix(), str(tmp_path / "in")
    sofar, kept = [], []
    for k in range(CHUNKS):
        rows = [(i, j, float(dense[i, j])) for i in range(k, ROWS, CHUNKS) for j in range(COLUMNS) if dense[i, j] != 0]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        sofar += rows
        kept.append(list(sofar))
    obs, var = spark.range(ROWS).select(F.col("id").alias("obs_id")), spark.range(COLUMNS).select(F.col("id").alias("var_id"))
    containers = [ExprData(spark.createDataFrame(rows, SCHEMA), obs, var) for rows in kept]
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), containers


def batches(stream, key, folder):
    """The statistics known after each batch, by id."""
    known, seen = {}, []

    def take(rows, _):
        known.update({r[key]: r.asDict() for r in rows.collect()})
        seen.append(dict(known))

    query = stream.writeStream.outputMode("update").option("checkpointLocation", folder).foreachBatch(take).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return seen


def same(a, b):
    if isinstance(a, list):
        return a == b
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def expected(data, direction, names):
    out = {}
    for frame in names:
        for r in frame(data, direction).collect():
            out.setdefault(r[direction.key], {}).update(r.asDict())
    return out


@pytest.mark.parametrize("direction", list(Direction))
def test_moments_after_each_batch(spark, chunks, tmp_path, direction):
    stream, containers = chunks
    length = containers[0].length(direction.other)
    seen = batches(running_moments(stream, direction, length), direction.key, str(tmp_path / "state"))
    assert len(seen) == CHUNKS
    dense = matrix()
    for got, data in zip(seen, containers, strict=True):
        want = expected(data, direction, (statistics.count_and_total, statistics.min_max))
        held = {r["obs_id"] for r in data.x.select("obs_id").distinct().collect()}
        now = np.where(np.isin(np.arange(ROWS), list(held))[:, None], dense, 0.0)
        variance = now.var(axis=1 if direction is Direction.ROW else 0, ddof=1)
        assert got and all(same(row[k], want[i][k]) for i, row in got.items() for k in ("n", "total", "min", "max"))
        assert all(same(row["variance"], variance[i]) for i, row in got.items())
        # What hasn't come is zero throughout.
        assert all(want[i]["n"] == 0 for i in want if i not in got)


@pytest.mark.parametrize("direction", list(Direction))
def test_largest_after_each_batch(spark, chunks, tmp_path, direction):
    stream, containers = chunks
    seen = batches(running_n_top(stream, direction, containers[0].length(direction.other), 4), direction.key, str(tmp_path / "state"))
    assert len(seen) == CHUNKS
    for got, data in zip(seen, containers, strict=True):
        want = {r[direction.key]: r["top"] for r in statistics.n_top(data, direction, 4).collect()}
        assert got and all(row["top"] == want[i] for i, row in got.items())


def test_nulls_no_rows_and_short_axes(spark):
    """The same plans run over a table: null and NaN are zeros, and a variance needs a length of two."""
    rows = spark.createDataFrame([(0, 0, None), (1, 0, float("nan")), (2, 0, -3.0)], SCHEMA)
    got = {r["obs_id"]: tuple(r)[1:] for r in running_moments(rows, Direction.ROW, 2).collect()}
    assert got == {0: (0, 0.0, 0.0, 0.0, 0.0), 1: (0, 0.0, 0.0, 0.0, 0.0), 2: (1, -3.0, 4.5, -3.0, 0.0)}
    assert [r["variance"] for r in running_moments(rows, Direction.ROW, 1).collect()] == [None] * 3
    assert running_moments(rows.where("false"), Direction.ROW, 2).count() == 0
    with pytest.raises(ValueError, match="more than the 2"):
        running_n_top(rows, Direction.ROW, 2, 3)
    with pytest.raises(Exception, match="more than 1 entries"):
        running_moments(rows, Direction.COLUMN, 1).collect()
