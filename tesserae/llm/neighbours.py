"""Approximate nearest neighbours by cosine, with cross-polytope hashing.

A unit vector is turned by fast pseudo-rotations (three rounds of random signs and a Hadamard transform) and hashed to the
nearest signed axis of each. A table's key joins the axes of AXES rotations, whatever the number of vectors. A query probes all
keys whose axes are together near enough to it: the sum of its components along them reaches a limit, in units of what a
component of a random unit vector is, so the share of keys that it looks into doesn't depend on the number of vectors or their
width. What it finds is ranked by its exact cosine.

The limit falls in levels: a query is done where its K-th neighbour is so near that a level's limit misses none of that kind
(but for a small probability), so queries with near neighbours look at little, and ones with none near look at everything.

Rows are collapsed to distinct vectors first: of each, the smallest ids that a query can return are enough, so a vector that
a third of the rows share is one candidate. Vectors and queries meet by a key's first axis in blocks of about BLOCK vectors, and
the other axes select within a block. A task holds one block, takes its queries as a stream, and returns the best few of each
that reach what the level before found, so a large bucket is many tasks and none holds all queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.scratch import Scratch

#: Neighbours of a query, tables, axes that are joined in a key, and vectors of a block.
K, TABLES, AXES, BLOCK = 5, 6, 3, 4096
#: Levels: tables; the sum that a probed key's axes reach, and what its first one reaches at least, by the length that a component
#: of a random unit vector has; the cosine from which on a K-th neighbour is near enough.
LEVELS = ((3, 4.2, 1.0, 0.75), (TABLES, 3.0, 0.4, 0.3))
#: Pairs ranked at once, and buckets that a table's first axes are dealt into, which changes nothing but the tasks.
PAIRS, BUCKETS = 1 << 16, 32
#: Slack of scores against rounding.
SLACK = 1e-12

_SEED = 1


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two. A step does six levels of additions as one product with a small matrix."""
    n, width = x.shape
    step = 1
    while step < width:
        radix = min(64, width // step)
        small = _signs(radix)
        x = np.swapaxes(x.reshape(n, width // (step * radix), radix, step), 2, 3)
        x = np.swapaxes((x.reshape(-1, radix) @ small).reshape(n, width // (step * radix), step, radix), 2, 3).reshape(n, width)
        step *= radix
    return x / np.sqrt(width)


@cache
def _signs(width: int) -> np.ndarray:
    """Hadamard's matrix: the sign at i, j is that of the number of ones which i and j share."""
    both = np.arange(width)[:, None] & np.arange(width)
    return 1.0 - 2.0 * (np.bitwise_count(both) % 2)


def rotations(x: np.ndarray, number: int) -> np.ndarray:
    """The pseudo-rotation of that number, the same on every machine; rows are padded with zeros to a power of two."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1]))) if width > x.shape[1] else x
    for s in _flips(number, width):
        x = hadamard(x * s)
    return x


@cache
def _flips(number: int, width: int) -> np.ndarray:
    return np.random.default_rng([_SEED, number]).choice([-1.0, 1.0], size=(3, width))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def axes(x: np.ndarray, number: int) -> np.ndarray:
    """How near each row is to each signed axis: the positive ones, then the negative ones."""
    turned = rotations(x, number)
    return np.concatenate([turned, -turned], axis=1)


def probes(x: np.ndarray, table: int, joined: int, most: int) -> np.ndarray:
    """The nearest keys of each row, nearest first: the most sums of one axis of each of the joined rotations. The first is the row's own."""
    keys = best = None
    for j in range(joined):
        near = axes(x, table * joined + j)
        width = near.shape[1]
        top = near.argmax(axis=1)[:, None] if most == 1 else np.argsort(-near, axis=1, kind="stable")[:, :most]
        value = np.take_along_axis(near, top, axis=1)
        if keys is None:
            keys, best = top.astype(np.int64), value
            continue
        both = (best[:, :, None] + value[:, None, :]).reshape(len(x), -1)
        joint = (keys[:, :, None] * width + top[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :most]
        keys, best = np.take_along_axis(joint, order, axis=1), np.take_along_axis(both, order, axis=1)
    return keys


def first_axes(x: np.ndarray, table: int, reach: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and first axes of the keys that each row probes: of length least, and with which some key's sum can reach `reach`."""
    near = [axes(x, table * AXES + j) for j in range(AXES)]
    unit_length = np.sqrt(near[0].shape[1] / 2)
    others = sum(n.max(axis=1, keepdims=True) for n in near[1:])
    return np.nonzero((near[0] * unit_length >= least) & ((near[0] + others) * unit_length >= reach))


def reached(q: np.ndarray, keys: np.ndarray, table: int, reach: float, least: float) -> np.ndarray:
    """Which of the keys each row of q reaches, with a first axis of length least."""
    total: np.ndarray | float = 0.0
    for j in reversed(range(AXES)):
        near = axes(q, table * AXES + j)
        near *= np.sqrt(near.shape[1] / 2)
        keys, own = keys // near.shape[1], keys % near.shape[1]
        along = near[:, own]
        total = total + along
    return (total >= reach) & (along >= least)


def _vectors(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrices of vectors of each width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(width)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        yield rows, flat[(ends[rows] - w)[:, None] + np.arange(w)]


def _keyed(classes: DataFrame, of: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]], tables: int, vectors: bool = True) -> DataFrame:
    """class, vector, bound, width, table, bucket (of a key's first axis) and key of the rows, buckets and keys that `of` gives for unit vectors and a table."""
    names = ["class", "vector", "bound", "width", "table", "bucket", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _vectors(batch.column(1)) if batch.num_rows else ():
                x = unit(x)
                for table in range(tables):
                    row, bucket, key = of(x, table)
                    at = pa.array(rows[row])
                    same = (pa.array(np.full(len(row), n, np.int32)) for n in (x.shape[1], table))
                    given = batch.column(1).take(at) if vectors else pa.nulls(len(row), batch.column(1).type)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), given, batch.column(2).take(at), *same, pa.array(bucket, pa.int32()), pa.array(key, pa.int64())], names)

    kind = classes.schema["vector"].dataType.simpleString()
    bound = "bound" if "bound" in classes.columns else F.lit(None).cast("double").alias("bound")
    return classes.select("class", "vector", bound).mapInArrow(run, f"class long, vector {kind}, bound double, width int, table int, bucket int, key long")


def keyed(classes: DataFrame, tables: int, vectors: bool = True) -> DataFrame:
    """The own key of each class in each table; a table's first axes are dealt into buckets."""

    def own(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = probes(x, table, AXES, 1)[:, 0]
        return np.arange(len(x)), key // axes(x[:1], 0).shape[1] ** (AXES - 1) % BUCKETS, key

    return _keyed(classes, own, tables, vectors)


def probed(classes: DataFrame, tables: int, reach: float, least: float) -> DataFrame:
    """The buckets of the first axes that each class probes in each table."""

    def some(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, axis = first_axes(x, table, reach, least)
        row, bucket = np.divmod(np.unique(row * BUCKETS + axis % BUCKETS), BUCKETS)
        return row, bucket, np.zeros(len(row), np.int64)

    return _keyed(classes, some, tables)


def _measured(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their lengths; rows whose square overflows or vanishes are scaled first, which doesn't turn them."""
    with np.errstate(over="ignore", under="ignore"):
        square = (x * x).sum(axis=1)
    odd = ~np.isfinite(square) | (square < 1e-290) | (square > 1e290)
    if odd.any():
        x = np.where(odd[:, None], x / np.abs(x).max(axis=1, keepdims=True), x)
    return x, np.linalg.norm(x, axis=1)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    (q, n), (x, m) = _measured(q), _measured(x)
    return (q @ x.T) / (n[:, None] * m[None, :])


def _best(query: np.ndarray, found: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The K + 1 best of each query, ties to the smaller number."""
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    begin = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    few = np.arange(len(query)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(query)]]))) <= K
    return query[few], found[few], score[few]


def _search(reach: float | None, least: float | None) -> Callable:
    """The best K + 1 classes of a block for each query; one more, as the query's own class may have no other row. Without a reach all are looked at."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = key[1].as_py()
        ids, keys, parts = [], [], []
        x = None
        for batch in batches:
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            own = batch.filter(pa.array(~asks))
            if own.num_rows:
                if x is not None:
                    raise RuntimeError("a block's vectors come before its queries")
                ids.append(own.column(0).to_numpy())
                keys.append(own.column(3).to_numpy())
                parts += [m for _, m in _vectors(own.column(1))]
            batch = batch.filter(pa.array(asks))
            if not batch.num_rows or not ids:
                continue
            if x is None:
                x, ids, keys = np.concatenate(parts), [np.concatenate(ids)], [np.concatenate(keys)]
                data, length = _measured(x)
            queries, bound = batch.column(0).to_numpy(), np.nan_to_num(batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64), nan=-2.0) - SLACK
            for i in range(0, len(queries), 256):
                ((_, q),) = _vectors(batch.column(1).slice(i, 256))
                hit = np.ones((len(q), len(x)), bool) if reach is None else reached(unit(q), keys[0], table, reach, least)
                row, col = np.nonzero(hit)
                q, long = _measured(q)
                score = np.concatenate([np.einsum("ij,ij->i", q[row[a : a + PAIRS]], data[col[a : a + PAIRS]]) for a in range(0, len(row), PAIRS)] or [np.zeros(0)])
                score = score / (long[row] * length[col])
                enough = score >= bound[i + row]
                found = _best(queries[i + row[enough]], ids[0][col[enough]], score[enough])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query", "class", "score"])

    return run


def nearest(spark: SparkSession, rows: DataFrame, is_query: Column) -> DataFrame:
    """query_id, rank, vec_id and score: the K rows of rows (vec_id, embedding) found nearest to each row that is a query.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without a vec_id; vectors of
    another length than a query's aren't its candidates. Ties go to the smaller vec_id, and a query isn't its own candidate.
    Every vector is indexed. Other columns are not looked at.
    """
    room = Scratch(spark, "neighbours")
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    own = own.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    own = own.withColumn("digest", F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(_SEED), "vector"))))
    # Of equal vectors a query can return the K smallest ids besides its own; Spark limits these before it shuffles them.
    few = own.withColumn("n", F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))).where(F.col("n") <= K + 1)
    members = room.keep(few.select("digest", "vec_id", "vector", "n"), "members")
    classes = members.where("n = 1").select(F.col("vec_id").alias("class"), "vector", "digest")
    asked = room.keep(own.where("asks").select(F.col("vec_id").alias("query_id"), "digest").join(classes.select("class", "digest"), "digest").select("query_id", "class"), "asked")
    ids = members.join(members.where("n = 1").select("digest", F.col("vec_id").alias("class")), "digest").select("class", "vec_id")

    axis, place = ["width", "table", "bucket"], ["width", "table", "bucket", "block"]
    # At most BUCKETS rows for each table and width, however many vectors there are.
    sizes = keyed(classes, TABLES, False).groupBy(*axis).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    sizes = room.keep(sizes, "sizes")

    def best(sought: DataFrame, tables: int, reach: float | None, least: float | None) -> DataFrame:
        """The K + 1 best classes of each query class."""
        dealt = keyed(classes, tables).join(sizes, axis).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        asks = sought.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = dealt.select("class", "vector", F.lit(False).alias("asks"), "key", "bound", *place).union(asks.select("class", "vector", F.lit(True), F.lit(0).cast("long"), "bound", *place))
        both = both.repartition(*place).sortWithinPartitions(*place, "asks")
        found = both.groupBy(*place).applyInArrow(_search(reach, least), "query long, class long, score double")
        found = found.groupBy("query", "class").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))
        return found.withColumn("n", rank).where(F.col("n") <= K + 1)

    def answers(found: DataFrame, of: DataFrame) -> DataFrame:
        pairs = of.withColumnRenamed("class", "query").join(found, "query").join(ids, "class").where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= K)

    left, results = asked.withColumn("bound", F.lit(None).cast("double")), []
    for level, (tables, reach, least, sure) in enumerate((*LEVELS, (1, None, None, None))):
        # What a query found before bounds what it can still return: only scores as large leave a block.
        bounds = left.groupBy("class").agg(F.when(F.count("bound") == F.count(F.lit(1)), F.min("bound")).alias("bound"))
        open_ = classes.join(bounds, "class").select("class", "vector", "bound")
        if reach is None:
            sought = open_.withColumn("width", F.size("vector")).join(F.broadcast(sizes.where(F.col("table") == 0)), "width")
        else:
            sought = probed(open_, tables, reach, least).drop("key").join(sizes, axis)
        got = room.keep(answers(best(sought, tables, reach, least), left.drop("bound")), f"level-{level}")
        if reach is None:
            results.append(got)
            break
        done = got.where((F.col("rank") == K) & (F.col("score") >= sure)).select("query_id")
        results.append(got.join(done, "query_id", "left_semi"))
        bound = got.where(F.col("rank") == K).select("query_id", F.col("score").alias("bound"))
        left = room.keep(left.drop("bound").join(done, "query_id", "left_anti").join(bound, "query_id", "left"), f"left-{level}")
        if not left.limit(1).count():
            break
    return reduce(DataFrame.union, results)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op1_neighbours": op1_neighbours}
