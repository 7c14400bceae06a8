"""Exact top-k inner products of integer vectors by best-first search of M-trees.

The largest inner products are the nearest neighbours once each vector v has a further component sqrt(M - |v|^2), where M
is the largest squared length, and each query has 0 there: squared distances are then |q|^2 + M - 2 q.v. An M-tree pages
its vectors: an entry of an inner node has a routing vector, the radius that covers what is below, and its distance to the
node's own routing vector; an entry of a leaf has that distance too. A search keeps nodes in a heap by the least distance
that they can hold; the triangle inequality over stored distances spares computing most others, and nothing is skipped that
could tie. Scores are exact integers.

The upper level of the tree is Spark's: sampled pivots are routing vectors, each row goes to the shard of its nearest pivot,
and a shard has a covering radius. A shard over SHARD rows is cut by a hash into blocks, and each block is an M-tree in a task
of its own. A query is searched in the shard of its nearest pivot first; its K-th score there bounds what it needs of the others, so it goes
only to shards whose radius can hold as much. Vectors are shuffled to their shard, queries are copied to the shards that they need,
and a task takes its queries as a stream, so it holds one tree and a batch of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.scratch import Scratch

#: Results of a query, scale of components, vectors of a page, entries of an inner node, vectors of a block, queries taken at once.
K, SCALE, PAGE, FANOUT, SHARD, ASKED = 5, 256, 512, 16, 8192, 512
#: Most pivots of a width, and most bytes of them.
PIVOTS, PIVOT_BYTES = 4096, 1 << 24
#: Slack of distances against rounding, relative to the largest one: where squared lengths are exact doubles, and where not.
SLACK, WIDE_SLACK = 1e-9, 1e-6
#: Integers below EXACT are exact doubles; components up to LARGEST have squares that are doubles.
EXACT, LARGEST = float(1 << 53), 1e150
#: What stands for scores that are beyond 64 bits.
TOO_SMALL, TOO_LARGE = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector has finite components only; an empty one does."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def scaled(vectors: list[list[float]] | np.ndarray) -> np.ndarray:
    """Components as floor(SCALE * x), which are integers however large; ValueError where their squares are beyond doubles."""
    x = np.array(vectors, dtype=np.float64)
    x = np.floor(SCALE * (x if x.ndim == 2 else x.reshape(len(vectors), -1)))
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError("a component is too large for distances in doubles")
    return x


def products(x: np.ndarray, q: np.ndarray, largest: float | None = None, strict: bool = True) -> np.ndarray:
    """Exact inner products of the rows of x with q. largest bounds the components of x.

    A sum whose terms have a total size below EXACT is exact in doubles, and one below 64 bits in integers; others are added up in
    Python's integers, row by row. Those that don't fit in 64 bits are a ValueError, or where not strict TOO_SMALL or TOO_LARGE."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if (np.abs(x).max() if largest is None else largest) * np.abs(q).max() * x.shape[1] < EXACT:
        return (x @ q).astype(np.int64)
    size = (np.abs(x) @ np.abs(q)) * (1 + 1e-15 * (x.shape[1] + 2))
    out = np.zeros(len(x), np.int64)
    doubles, longs = size < EXACT, (size >= EXACT) & (size < float(1 << 63))
    out[doubles] = (x[doubles] @ q).astype(np.int64)
    # A component beyond 64 bits meets a zero here, or its row's size were larger.
    both = np.minimum(np.abs(x[longs]), 2.0**62) * np.sign(x[longs]), np.minimum(np.abs(q), 2.0**62) * np.sign(q)
    out[longs] = both[0].astype(np.int64) @ both[1].astype(np.int64)
    whole = [int(v) for v in q.tolist()]
    for i in np.flatnonzero(~doubles & ~longs).tolist():
        score = sum(int(a) * b for a, b in zip(x[i].tolist(), whole, strict=True))
        if strict and not TOO_SMALL <= score <= TOO_LARGE:
            raise ValueError("an inner product is too large for 64 bits")
        out[i] = min(max(score, TOO_SMALL), TOO_LARGE)
    return out


def slack_of(longest: float) -> float:
    return SLACK if longest < EXACT else WIDE_SLACK


@dataclass
class Node:
    """A page: vectors are routing vectors in an inner node and the vectors themselves in a leaf; to_parent are their distances to the node's own routing vector."""

    vectors: np.ndarray
    extra: np.ndarray
    to_parent: np.ndarray
    rows: np.ndarray | None = None
    radii: np.ndarray | None = None
    below: list[Node] = field(default_factory=list)


def _distances(x: np.ndarray, extra: np.ndarray, q: np.ndarray, q_extra: float) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1) + (extra - q_extra) ** 2)


def build(x: np.ndarray, extra: np.ndarray, rows: np.ndarray, own: int) -> Node:
    """The page of some rows around routing row own, with pages below. Rows are distinct vectors, so every split divides them."""
    own_distance = _distances(x[rows], extra[rows], x[own], extra[own])
    if len(rows) <= PAGE:
        return Node(x[rows], extra[rows], own_distance, rows=rows)
    chosen, near = [], np.full(len(rows), np.inf)
    to = np.zeros(len(rows), np.int64)
    nxt = int(own_distance.argmax())
    for i in range(min(FANOUT, -(-len(rows) // PAGE) + 1)):
        chosen.append(rows[nxt])
        d = _distances(x[rows], extra[rows], x[rows[nxt]], extra[rows[nxt]])
        closer = d < near
        near[closer], to[closer] = d[closer], i
        nxt = int(near.argmax())
        if near[nxt] == 0:
            break
    routing = np.array(chosen)
    radii = np.array([near[to == i].max() for i in range(len(routing))])
    page = Node(x[routing], extra[routing], _distances(x[routing], extra[routing], x[own], extra[own]), radii=radii)
    page.below = [build(x, extra, rows[to == i], routing[i]) for i in range(len(routing))]
    return page


def reach_of(length: float, longest: float, score: int) -> float:
    """The distance beyond which no vector has so large a score with a query of that squared length."""
    return float(np.sqrt(max(length + longest - 2.0 * score, 0.0)) + slack_of(longest) * (1.0 + np.sqrt(length + longest)))


class Tree:
    """An M-tree over vectors with ids; of equal vectors the keep smallest ids."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, longest: float, keep: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.x, at = np.unique(x[order], axis=0, return_inverse=True)
        at = at.ravel()
        by = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[by], np.arange(len(self.x) + 1))
        self.ids = [ids[order][by[i : min(j, i + keep)]].tolist() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        self.extra = np.sqrt(np.maximum(longest - (self.x**2).sum(axis=1), 0))
        self.longest = longest
        self.largest = float(np.abs(self.x).max()) if self.x.size else 0.0
        self.root = build(self.x, self.extra, np.arange(len(self.x)), 0)
        self.computed = 0

    def search(self, q: np.ndarray, own: int | None, k: int = K, bound: int | None = None) -> list[tuple[int, int]]:
        """The k largest scores of ids other than own, as score and id, ties by id; of scores below bound some or none."""
        length = float(q @ q)
        slack = slack_of(self.longest) * (1.0 + np.sqrt(length + self.longest))
        best: list[tuple[int, int]] = []
        limit = np.inf if bound is None else reach_of(length, self.longest, bound)
        to_root = float(_distances(self.x[:1], self.extra[:1], q, 0.0)[0])
        heap: list[tuple[float, int, Node, float]] = [(0.0, 0, self.root, to_root)]
        pushed = 0
        while heap:
            least, _, page, to_own = heapq.heappop(heap)
            if least > limit:
                break
            reach = np.abs(to_own - page.to_parent)
            if page.rows is not None:
                some = np.flatnonzero(reach <= limit)
                self.computed += len(some)
                scores = products(page.vectors if len(some) == len(reach) else page.vectors[some], q, self.largest, strict=False)
                floor = best[0][0] if len(best) == k else bound
                if floor is not None:
                    worth = scores >= floor
                    some, scores = some[worth], scores[worth]
                for score, row in sorted(zip(scores.tolist(), page.rows[some].tolist(), strict=True), reverse=True):
                    if len(best) == k and score < best[0][0]:
                        break
                    for i in self.ids[row]:
                        if i == own:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, (score, -i))
                        elif (score, -i) > best[0]:
                            heapq.heapreplace(best, (score, -i))
                        else:
                            break
                if len(best) == k:
                    limit = min(limit, reach_of(length, self.longest, best[0][0]))
                continue
            some = np.flatnonzero(reach - page.radii <= limit)
            self.computed += len(some)
            d = _distances(page.vectors[some], page.extra[some], q, 0.0)
            for i, distance in zip(some.tolist(), d.tolist(), strict=True):
                least = max(distance - float(page.radii[i]) - slack, 0.0)
                if least <= limit:
                    pushed += 1
                    heapq.heappush(heap, (least, pushed, page.below[i], distance))
        return sorted(((s, -i) for s, i in best), key=lambda r: (-r[0], r[1]))


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Scaled vectors of one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


@dataclass
class Upper:
    """The pivots of one width: routing vectors of shards, the largest squared length of a row, and covering radii and blocks of shards."""

    x: np.ndarray
    longest: float
    radius: np.ndarray
    blocks: np.ndarray

    def distances(self, x: np.ndarray, as_query: bool = False) -> np.ndarray:
        """From each row of x to each pivot."""
        length, own = (x**2).sum(axis=1), (self.x**2).sum(axis=1)
        extra = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(self.longest - length, 0))
        other = np.sqrt(np.maximum(self.longest - own, 0))
        return np.sqrt(np.maximum(length[:, None] + own - 2 * (x @ self.x.T), 0) + (extra[:, None] - other) ** 2)


def _told(batch: pa.RecordBatch, of: Callable[[pa.RecordBatch, int], tuple[np.ndarray, dict[str, pa.Array]]]) -> Iterator[pa.RecordBatch]:
    """Of each width: the rows and the columns that `of` gives."""
    width = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
    for w in np.unique(width):
        part = batch.take(pa.array(np.flatnonzero(width == w)))
        row, more = of(part, int(w))
        taken = part.take(pa.array(row))
        yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(np.full(len(row), w, np.int32)), *more.values()], ["vec_id", "vector", "width", *more])


def _floored(x: Column) -> Column:
    """floor(SCALE * x) as a double; doubles from EXACT on are integers."""
    y = F.lit(SCALE) * x.cast("double")
    return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)


def upper_level(own: DataFrame) -> dict[int, Upper]:
    """Pivots by width: those rows with the least hash, of at most PIVOT_BYTES. All widths are looked at in the same two jobs;
    only rows whose hash is below a bound, some times as many as are wanted, are put in order."""
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.pow(_floored(x), 2))
    widths = own.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).collect()
    if not widths:
        return {}
    bounds = []
    for r in widths:
        most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * max(1, r["width"])), -(-r["n"] // SHARD)))
        share = min(1.0, (4 * most + 64) / r["n"])
        bounds.append((r["width"], most, min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))))
    hashed = own.select("vec_id", "vector", F.size("vector").alias("width"), F.xxhash64("vec_id", "vector").alias("hash"))
    near = hashed.join(own.sparkSession.createDataFrame(bounds, "width int, most int, bound long"), "width").where("hash <= bound")
    place = F.row_number().over(Window.partitionBy("width").orderBy("hash", "vec_id"))
    rows = near.withColumn("place", place).where("place <= most").select("width", "vector").collect()  # at most PIVOTS of a width
    upper = {}
    for r in widths:
        x = np.unique(scaled([v["vector"] for v in rows if v["width"] == r["width"]]), axis=0)
        upper[r["width"]] = Upper(x, float(r["longest"]), np.zeros(len(x)), np.ones(len(x), np.int64))
    return upper


def dealt(own: DataFrame, upper: dict[int, Upper]) -> DataFrame:
    """vec_id, vector, width, pivot and distance: each row's nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nearest(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
            d = upper[width].distances(_vectors(part.column(1)))
            to = d.argmin(axis=1)
            return np.arange(len(d)), {"pivot": pa.array(to, pa.int32()), "distance": pa.array(d[np.arange(len(d)), to])}

        for batch in batches:
            yield from _told(batch, nearest)

    kind = own.schema["vector"].dataType.simpleString()
    return own.select("vec_id", "vector").mapInArrow(run, f"vec_id long, vector {kind}, width int, pivot int, distance double")


def routed(queries: DataFrame, upper: dict[int, Upper], first: bool) -> DataFrame:
    """vec_id, vector, width, least, pivot and block of each query (vec_id, vector, least): all blocks of the shard of its nearest pivot,
    or of each other shard that can hold a score of `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
            top, q = upper[width], _vectors(part.column(1))
            d = top.distances(q, True)
            home = np.arange(len(top.x)) == d.argmin(axis=1)[:, None]
            if not first:
                limit = [np.inf if s is None else reach_of(float(v @ v), top.longest, s) for v, s in zip(q, part.column(2).to_pylist(), strict=True)]
                home = ~home & (d - top.radius <= np.array(limit)[:, None] * (1 + SLACK))
            row, pivot = np.nonzero(home)
            many = top.blocks[pivot]
            row, pivot = np.repeat(row, many), np.repeat(pivot, many)
            block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            return row, {"least": part.column(2).take(pa.array(row)), "pivot": pa.array(pivot, pa.int32()), "block": pa.array(block, pa.int32())}

        for batch in batches:
            yield from _told(batch, places)

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("vec_id", "vector", "least").mapInArrow(run, f"vec_id long, vector {kind}, width int, least long, pivot int, block int")


def _search(longest: dict[int, float], counted: Accumulator | None) -> Callable:
    """The best K of a block for each query, among scores of `least` and more."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, tree = [], [], None
        for batch in batches:
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            own = batch.filter(pa.array(~asks))
            if own.num_rows:
                if tree is not None:
                    raise RuntimeError("a block's vectors come before its queries")
                ids.append(own.column(0).to_numpy())
                parts.append(_vectors(own.column(1)))
            batch = batch.filter(pa.array(asks))
            if not batch.num_rows or not ids:
                continue
            tree = tree or Tree(np.concatenate(parts), np.concatenate(ids), longest[key[0].as_py()], K + 1)
            for i in range(0, batch.num_rows, ASKED):
                some = batch.slice(i, ASKED)
                q, names = _vectors(some.column(1)), some.column(0).to_pylist()
                out = [(name, vec, score) for v, name, least in zip(q, names, some.column(3).to_pylist(), strict=True) for score, vec in tree.search(v, name, K, least)]
                query, vec, score = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])
        if counted is not None and tree is not None:
            counted.add(tree.computed)

    return run


def largest_products(rows: DataFrame, is_query: Column, counted: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the K rows of rows (vec_id, embedding) with the largest integer inner product with each query.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id. Ties go to the
    smaller vec_id, and a query isn't its own candidate; vectors of another length than a query's aren't either. Other columns are not
    looked at. Scores are exact 64-bit integers: a score of the result that is beyond them is an error that says so, and so is a
    component beyond LARGEST. counted takes the number of distances that were computed.
    """
    room = Scratch(rows.sparkSession, "mtree")
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    own = own.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # Of equal vectors a query can return the K smallest ids besides its own; Spark limits these before it shuffles them.
    same = Window.partitionBy(F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"), F.size("vector")).orderBy("vec_id")
    few = room.keep(own.withColumn("n", F.row_number().over(same)).where(F.col("n") <= K + 1).select("vec_id", "vector"), "members")
    queries = room.keep(own.where("asks").select("vec_id", "vector"), "queries")
    upper = upper_level(few)
    placed = room.keep(dealt(few, upper), "placed")
    # At most PIVOTS rows of each width.
    for r in placed.groupBy("width", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect():
        top = upper[r["width"]]
        top.blocks[r["pivot"]], top.radius[r["pivot"]] = -(-r["n"] // SHARD), r["radius"] * (1 + SLACK)
    sizes = rows.sparkSession.createDataFrame([(w, p, int(b)) for w, top in upper.items() for p, b in enumerate(top.blocks)], "width int, pivot int, blocks int")
    place = ["width", "pivot", "block"]
    data = placed.join(F.broadcast(sizes), ["width", "pivot"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    run = _search({w: top.longest for w, top in upper.items()}, counted)

    def found(asked: DataFrame, first: bool) -> DataFrame:
        both = data.select("vec_id", "vector", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("least"), *place)
        both = both.union(routed(asked, upper, first).select("vec_id", "vector", F.lit(True), "least", *place))
        both = both.repartition(*place).sortWithinPartitions(*place, "asks")
        return both.groupBy(*place).applyInArrow(run, "query_id long, vec_id long, score long")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def best(some: DataFrame) -> DataFrame:
        return some.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= K)

    at_home = room.keep(best(found(queries.withColumn("least", F.lit(None).cast("long")), True)), "home")
    bound = at_home.where(F.col("rank") == K).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    other = found(queries.join(bound, "vec_id", "left"), False)
    whole = best(at_home.drop("rank").select("query_id", "vec_id", "score").union(other))
    beyond = F.raise_error(F.lit("an inner product is too large for 64 bits")).cast("long")
    return whole.withColumn("score", F.when(F.col("score").isin(TOO_SMALL, TOO_LARGE), beyond).otherwise(F.col("score")))


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


QUERIES = {"op2_mtree": op2_mtree}

ORACLES = {
    "op2_mtree": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.x, v.x), lambda t: t[1] * t[2])) as bigint) as score
      from v q join v on v.vec_id <> q.vec_id and len(v.x) = len(q.x) where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5"""
}
