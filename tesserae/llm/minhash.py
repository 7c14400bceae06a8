"""Near-duplicate documents by tensored MinHash banding, with links confirmed on full shingle sets.

A document's set is that of its 5-word shingles. SIDE sub-keys of two minhashes each form collection A, and as many form
collection B; each pair of one from A and one from B is a table key, so SIDE * SIDE tables take 4 * SIDE minhashes.
Documents are linked where 100 * intersection >= 75 * union; at exactly that similarity a pair shares no key with a
probability of about 5e-4, and it falls steeply above.

1. Documents of equal sets are one class from here on, so exact copies cost nothing more.
2. Sub-keys are counted, pre-aggregated in each task; keys are formed of those that occur again only.
3. In a bucket of a key, classes whose sketches agree in at least AGREE of SKETCH bytes (a link has less with a probability
   of 1e-6) become a family: a spanning forest of them is emitted, never the pairs. A bucket of over MEET classes is cut into
   blocks, and each pair of blocks meets in a task of its own.
4. The sets of a family meet in one task, which finds all links and emits each class's component. A family over BLOCK
   classes is cut into blocks, and each pair of blocks meets in a task of its own, which emits a spanning forest.
5. Connected components by alternating stars, each round written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.blobs import FREQUENT, REPEAT, ROWS, blob_rows, bucket_of, by_part, dealt_keys, mixed, pack, passed, settled_keys, texts_of, unpack
from tesserae.llm.scratch import Scratch

WORDS = 5
#: Sub-keys of each collection; minhashes, of which one byte each is the sketch; bytes of it that a link must share.
SIDE, SKETCH, AGREE = 10, 64, 31
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Classes that meet in one task.
BLOCK = 1024
#: Rows of a sub-key beyond which a key's bucket is cut into blocks: so many at least, and so many of all classes, so that no
#: more than 2 * SIDE * 1,000 sub-keys can be frequent, whatever the corpus.
HOT, HOT_SHARE = 20_000, 1_000
#: Classes of one key that are compared in one task; a key of more is cut into blocks of half as many.
MEET = 20_000
#: Text bytes hashed at once (a longer text is hashed in pieces of so many), classes of a part, and shingles whose families share a task.
PIECE, PART_ROWS, TASK_SHINGLES = 1 << 20, 1 << 14, 1 << 19

_RNG = np.random.default_rng(6)
_XOR = _RNG.integers(1, 1 << 63, SKETCH, dtype=np.uint64)
_TIMES = _RNG.integers(1, 1 << 62, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWER = 0x9E3779B97F4A7C15

SKETCHES = "doc_id long, print long, n_shingles long, node binary, keys binary, sketch binary"


def _powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), _POWER, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _runs(word: np.ndarray) -> np.ndarray:
    """The hash of each WORDS consecutive words."""
    power = [np.uint64(x) for x in _powers(WORDS)]
    n = len(word) - WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    runs = word[:n] * power[WORDS - 1]
    for k in range(1, WORDS):
        runs = runs + word[k : k + n] * power[WORDS - 1 - k]
    return mixed(runs)


def _sequence(word: np.ndarray) -> np.ndarray:
    """The hash of a whole sequence of fewer words; none without words."""
    if not len(word):
        return word
    total = (word * _powers(len(word))).sum(dtype=np.uint64)
    return mixed(np.array([total], np.uint64) ^ np.uint64(len(word)))


def _words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of lower-case bytes starts and ends, and the sum of its bytes' values by their places in it."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    size = ends - starts
    place = np.arange(len(data))
    place[starts[0] :] -= np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]])))
    value = _BYTES[data] * _powers(int(size.max()) + 1)[np.clip(place, 0, int(size.max()))]
    value[space] = 0
    return starts, ends, np.add.reduceat(value, starts)


def word_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the words of a text by pieces of PIECE bytes. Of a word that goes on in the next piece its sum and size are kept, so it may be of any length."""
    total, length = 0, 0
    for at in range(0, len(text), PIECE):
        data = _LOWER[np.frombuffer(text, np.uint8, min(PIECE, len(text) - at), at)]
        starts, ends, sums = _words_of(data)
        size = (ends - starts).astype(np.uint64)
        if length and len(starts) and starts[0] == 0:
            sums[:1] = sums[:1] * np.uint64(pow(_POWER, length, 1 << 64)) + np.uint64(total)
            size[:1] += np.uint64(length)
        elif length:
            sums, size = np.concatenate([[np.uint64(total)], sums]), np.concatenate([[np.uint64(length)], size])
        total, length = 0, 0
        if len(starts) and ends[-1] == len(data) and at + len(data) < len(text):
            total, length = int(sums[-1]), int(size[-1])
            sums, size = sums[:-1], size[:-1]
        yield mixed(sums + size)
    if length:
        yield mixed(np.array([total], np.uint64) + np.uint64(length))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted and distinct, in place."""
    hashes.sort()
    kept = min(1, len(hashes))
    for i in range(1, len(hashes), PIECE):
        part = hashes[i : i + PIECE]
        fresh = part[part != hashes[i - 1 : i - 1 + len(part)]]
        hashes[kept : kept + len(fresh)] = fresh
        kept += len(fresh)
    return hashes[:kept]


def long_set(text: bytes) -> np.ndarray:
    """What shingle_sets gives for one text, in memory of 8 bytes for each word beside the text."""
    n_words = sum(len(_words_of(np.frombuffer(text, np.uint8, min(PIECE, len(text) - at), at))[0]) for at in range(0, len(text), PIECE))
    found, n, tail = np.empty(n_words, np.uint64), 0, np.zeros(0, np.uint64)
    for words in word_hashes(text):
        words = np.concatenate([tail, words])
        runs = _runs(words)
        found[n : n + len(runs)] = runs
        n += len(runs)
        tail = words[max(0, len(words) - WORDS + 1) :]
    return _distinct(found[:n]) if n else _sequence(tail)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; the whole sequence's where it has fewer words; none without words."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        return [long_set(texts[0])]
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    starts, ends, sums = _words_of(data)
    word = mixed(sums + (ends - starts).astype(np.uint64))
    cuts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, cuts)
    runs = _runs(word)
    return [np.unique(runs[i : j - WORDS + 1]) if j - i >= WORDS else _sequence(word[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]


def _portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Texts that are hashed at once: some PIECE bytes, and one over PIECE by itself."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if len(text) > PIECE and begin < i:
            yield begin, i
            begin, size = i, 0
        size += len(text)
        if size >= PIECE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def node_of(shingles: np.ndarray) -> bytes:
    """A digest of a set; equal sets are one class."""
    return hashlib.blake2b(np.ascontiguousarray(shingles).data, digest_size=16).digest()


def minhashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1 << 10):
        least = np.minimum(least, ((shingles[i : i + (1 << 10), None] ^ _XOR) * _TIMES).min(axis=0))
    return mixed(least)


def sub_keys(least: np.ndarray) -> np.ndarray:
    """Two minhashes each: the first SIDE for collection A, the others for B."""
    pairs = least[: 4 * SIDE].reshape(2 * SIDE, 2)
    return mixed(pairs[:, 0] * np.uint64(_POWER) + pairs[:, 1] + np.arange(2 * SIDE, dtype=np.uint64))


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, and print: a hash of the text where doc_id is null."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.withColumn("print", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))


def sketches(docs: DataFrame) -> DataFrame:
    """SKETCHES of docs (doc_id, text). print is a hash of the text where doc_id is null, by which such a row is found again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            for i, j in _portions(texts):
                sets = shingle_sets(texts[i:j])
                least = [minhashes(s) for s in sets]
                columns = [
                    *(c[i:j] for c in batch.columns[:2]),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) for s in sets], pa.binary()),
                    pa.array([sub_keys(x).tobytes() for x in least], pa.binary()),
                    pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SKETCHES.split(", ")])

    return _marked(docs).select("doc_id", "print", "text").mapInArrow(run, SKETCHES)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def find_keys(classes: DataFrame, n_parts: int) -> DataFrame:
    """Sub-keys of classes (part, cid, keys) by their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, cid = _matrix(batch.column(2), "<u8", 2 * SIDE), batch.column(1).to_numpy()
                pos = np.tile(np.arange(2 * SIDE, dtype=np.int16), len(cid))
                yield blob_rows(dealt_keys(keys.ravel(), np.repeat(cid, 2 * SIDE), pos, np.repeat(batch.column(0).to_numpy(), 2 * SIDE), n_parts))

    return classes.select("part", "cid", "keys").mapInArrow(run, ROWS)


def settle_keys(found: DataFrame, n_parts: int, hot: int) -> DataFrame:
    """Places of repeated sub-keys by their classes' part, and frequent sub-keys with their counts."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part >= n_parts:
            return passed(rows, part - n_parts)
        return pa.Table.from_batches([blob_rows(settled_keys(unpack(rows.column("data").to_pylist()), hot)[0])])

    return found.groupBy("part").applyInArrow(run, ROWS)


def find_members(classes: DataFrame, repeats: DataFrame, n_parts: int, frequent: dict[int, int], most: int) -> DataFrame:
    """Members of keys of two repeated sub-keys, by bucket. Where both are frequent, a key is cut into blocks of about `most`, and a member goes to each pair of blocks that its block is of."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own = unpack(right.column("data").to_pylist())
        if not own or not len(left):
            return pa.Table.from_batches([blob_rows([])])
        cid = left.column("cid").to_numpy()
        order = np.argsort(cid)
        keys, sketch = _matrix(left.column("keys"), "<u8", 2 * SIDE)[order], _matrix(left.column("sketch"), "u1", SKETCH)[order]
        cid = cid[order]
        again = np.zeros((len(cid), 2 * SIDE), bool)
        again[np.searchsorted(cid, own["doc"]), own["pos"]] = True
        row, i, j = np.nonzero(again[:, :SIDE, None] & again[:, None, SIDE:])
        a, b = keys[row, i], keys[row, SIDE + j]
        h = mixed(a * np.uint64(_POWER) ^ b)
        if frequent:
            names = np.array(sorted(frequent), np.uint64)
            hot = np.flatnonzero(np.isin(a, names) & np.isin(b, names))
            many = np.array([-(-min(frequent[int(x)], frequent[int(y)]) // most) for x, y in zip(a[hot], b[hot], strict=True)], np.int64)
            block = (mixed(cid[row[hot]].astype(np.uint64)) % many.astype(np.uint64)).astype(np.int64) if len(hot) else many
            times = np.repeat(np.arange(len(hot)), many)
            other = np.arange(len(times)) - np.repeat(np.cumsum(many) - many, many)
            low, high = np.minimum(block[times], other), np.maximum(block[times], other)
            tile = mixed(h[hot][times] + (low * many[times] + high + 1).astype(np.uint64))
            calm = np.delete(np.arange(len(h)), hot)
            row, h = np.concatenate([row[calm], row[hot][times]]), np.concatenate([h[calm], tile])
        return pa.Table.from_batches([blob_rows([(p, REPEAT, pack(**c)) for p, c in by_part(bucket_of(h, n_parts), h=h, cid=cid[row], sketch=sketch[row])])])

    return classes.select("part", "cid", "keys", "sketch").groupBy("part").cogroup(repeats.groupBy("part")).applyInArrow(run, ROWS)


def _spread(sketch: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows that agree in AGREE bytes."""
    rest, edges = np.arange(1, len(sketch)), []
    front = [0]
    while True:
        while front and len(rest):
            at = front.pop()
            near = (sketch[rest] == sketch[at]).sum(axis=1) >= AGREE
            edges += [(at, int(x)) for x in rest[near]]
            front += rest[near].tolist()
            rest = rest[~near]
        if not len(rest):
            return edges
        front, rest = [int(rest[0])], rest[1:]


def family_edges(h: np.ndarray, cid: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Distinct pairs of classes that span the families of each key."""
    order = np.lexsort((cid, h))
    h, cid, sketch = h[order], cid[order], sketch[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    near = np.zeros(len(h), bool)
    for i in range(0, len(same), 1 << 15):
        at = same[i : i + (1 << 15)]
        near[at] = (sketch[at] == sketch[at + 1]).sum(axis=1) >= AGREE
    edges = [np.column_stack([cid[:-1][near[:-1]], cid[1:][near[:-1]]])]
    cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
    joined = np.concatenate([[0], np.cumsum(near)])
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j - i > 2 and joined[j - 1] - joined[i] < j - i - 1:
            found = _spread(sketch[i:j])
            if found:
                edges.append(cid[i:j][np.array(found)])
    found = np.sort(np.concatenate(edges), axis=1)
    return np.unique(found[found[:, 0] < found[:, 1]], axis=0)


def families(members: DataFrame, room: Scratch) -> DataFrame:
    """Edges a < b of classes of one family.

    A key of over MEET members isn't compared in its bucket's task: it goes on as blocks, each of which is copied to its pairs
    with all blocks of the key, and those pairs are tasks of at most some MEET members."""

    most = MEET

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own = unpack(rows.column("data").to_pylist())
        h, cid, sketch = own["h"], own["cid"], own["sketch"]
        _, name, count = np.unique(h, return_inverse=True, return_counts=True)
        large = count[name] > most
        edges = family_edges(h[~large], cid[~large], sketch[~large])
        solved = pa.table({"a": edges[:, 0], "b": edges[:, 1]}).cast(pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        blocks = []
        for k in np.flatnonzero(count > most).tolist():
            at, total = np.flatnonzero(name == k), int(-(-2 * count[k] // most))
            block = (mixed(cid[at].astype(np.uint64)) % np.uint64(total)).astype(np.int64)
            blocks += [{"h": int(h[at[0]].astype(np.int64)), "block": x, "total": total, "data": pack(**c)} for x, c in by_part(block, h=h[at], cid=cid[at], sketch=sketch[at])]
        cut = pa.Table.from_pylist(blocks, pa.schema([("h", pa.int64()), ("block", pa.int32()), ("total", pa.int32()), ("data", pa.binary())]))
        return pa.concat_tables([solved, cut], promote_options="default").select(["a", "b", "h", "block", "total", "data"])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        own = unpack(rows.column("data").to_pylist())
        edges = family_edges(own["h"], own["cid"], own["sketch"])
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    found = room.keep(members.groupBy("part").applyInArrow(run, "a long, b long, h long, block int, total int, data binary"), "met")
    edges, blocks = found.where("data is null").select("a", "b"), found.where("data is not null")
    other = F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("other")
    pairs = blocks.select("h", "block", other, "data").select("h", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "data")
    return edges.union(pairs.groupBy("h", "x", "y").applyInArrow(meet, "a long, b long"))


def components(edges: DataFrame, room: Scratch, name: str) -> DataFrame:
    """id and component (the least id reachable) of each id in edges (a, b), by alternating large and small stars.

    Each star is a group by a node that only takes a minimum and a join back to it, so no neighbourhood is gathered."""
    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = room.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    was, turn = state(now), 0
    while was[0]:
        turn += 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = room.keep(large.distinct(), f"{name}-large-{turn}")
        floor = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        then = room.keep(small.union(floor.select("a", F.col("least").alias("b"))).distinct(), f"{name}-{turn}")
        room.drop(f"{name}-large-{turn}")
        room.drop(f"{name}-{turn - 1}")
        now, last = then, was
        was = state(now)
        if was == last:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 100 * shared >= PERCENT * (size.sum() - shared) else []
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, name, count = np.unique(every, return_inverse=True, return_counts=True)
    common = count[name] > 1
    renamed = np.cumsum(count > 1) - 1
    name, owner = renamed[name[common]], owner[common]
    shared = np.zeros((n, n), np.float32)
    width = max(256, (1 << 22) // n)
    order = np.argsort(name, kind="stable")
    name, owner = name[order], owner[order]
    for low in range(0, int(name[-1]) + 1 if len(name) else 0, width):
        i, j = np.searchsorted(name, [low, low + width])
        has = np.zeros((n, width), np.float32)
        has[owner[i:j], name[i:j] - low] = 1
        shared += has @ has.T
    link = 100 * shared.astype(np.int64) >= PERCENT * (size[:, None] + size[None, :] - shared.astype(np.int64))
    rest, edges = np.ones(n, bool), []
    for root in range(n):
        if not rest[root]:
            continue
        rest[root] = False
        front = [root]
        while front:
            at = front.pop()
            near = np.flatnonzero(link[at] & rest)
            rest[near] = False
            edges += [(at, int(x)) for x in near]
            front += near.tolist()
    return edges


def _solve(cid: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components among classes, a class given twice counting once."""
    cid, at = np.unique(cid, return_index=True)
    if len(cid) < 2:
        return cid[:0], cid[:0]
    edges = np.array(linked([sets[i] for i in at]), np.int64).reshape(-1, 2)
    return cid[edges[:, 0]], cid[edges[:, 1]]


def confirm(docs: DataFrame, members: DataFrame, n_tasks: int) -> DataFrame:
    """Links a, b that span the components of each family. members: cid, family, size (its classes), node, and doc_id or else print of a document of the class."""
    blocks = F.ceil(F.col("size") / F.lit(float(BLOCK))).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    small = F.struct(F.pmod(F.xxhash64("family"), F.lit(n_tasks)).cast("long").alias("task"), F.lit(-1).alias("x"), F.lit(-1).alias("y"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.col("family").alias("task"), F.least(own, o).alias("x"), F.greatest(own, o).alias("y")))
    shape = ["node", "cid", "family", "tasks"]
    wanted = members.select("doc_id", "print", "node", "cid", "family", F.when(blocks <= 1, F.array(small)).otherwise(pairs).alias("tasks"))
    # Wanted ids grow with the corpus, so they are never broadcast, not even where they happen to be few.
    own = _marked(docs)
    texts = own.select("doc_id", "text").join(wanted.where("doc_id is not null").drop("print").hint("merge"), "doc_id").select("text", *shape)
    if members.where("doc_id is null").limit(1).count():
        # Classes of rows without an id: their texts are found by hash, one of each.
        nameless = own.where("doc_id is null").groupBy("print").agg(F.first("text").alias("text"))
        texts = texts.unionByName(nameless.join(wanted.where("doc_id is null").drop("doc_id").hint("merge"), "print").select("text", *shape))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(0))
            for i, j in _portions(texts):
                found = shingle_sets(texts[i:j])
                right = pa.array([node_of(s) == n for s, n in zip(found, batch.column(1)[i:j].to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[2:]), pa.array([s.tobytes() for s in found], pa.binary())], ["cid", "family", "tasks", "shingles"]).filter(right)

    kind = "cid long, family long, tasks array<struct<task: long, x: int, y: int>>, shingles binary"
    rows = texts.mapInArrow(sets, kind).select("cid", "family", F.explode("tasks").alias("t"), "shingles").select("cid", "family", "shingles", "t.task", "t.x", "t.y")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        family, cid = rows.column("family").to_numpy(), rows.column("cid").to_numpy()
        blobs = rows.column("shingles").to_pylist()
        order = np.argsort(family, kind="stable")
        cuts = np.flatnonzero(np.diff(family[order])) + 1
        found = [_solve(cid[part], [np.frombuffer(blobs[i], np.uint64) for i in part]) for part in np.split(order, cuts)]
        return pa.table({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})

    return rows.groupBy("task", "x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (component_id is the own one) of each row of docs (doc_id, text).

    Null and empty texts have empty sets, which are linked with nothing. Rows of a repeated doc_id are documents of their
    own that share its number. A row with a null doc_id is a document like any other, and links others; null is never a
    component's id unless all of its documents have none, and such rows are always kept. Other columns are not looked at.
    """
    room = Scratch(spark, "minhash")
    sketched = room.keep(sketches(docs), "sketches")
    one = sketched.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("print").alias("print"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    numbered = room.keep(one.withColumn("cid", F.monotonically_increasing_id()), "numbered")
    n = numbered.count()
    n_parts, hot = max(1, -(-n // PART_ROWS)), max(HOT, n // HOT_SHARE)
    classes = numbered.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(n_parts)).cast("int"))
    found = room.keep(settle_keys(find_keys(classes, n_parts), n_parts, hot), "keys")
    told = unpack([bytes(r["data"]) for r in found.where(F.col("kind") == FREQUENT).select("data").collect()])  # at most 2 * SIDE * HOT_SHARE sub-keys
    frequent = dict(zip(told["h"].tolist(), told["count"].tolist(), strict=True)) if told else {}
    members = find_members(classes, found.where(F.col("kind") == REPEAT).select("part", "data"), n_parts, frequent, hot)
    family = components(families(members, room), room, "families").withColumnsRenamed({"id": "cid", "component": "family"})
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    wanted = room.keep(family.join(sizes, "family").join(numbered.select("cid", "node", "doc_id", "print", "n"), "cid"), "wanted")
    n_tasks = max(1, -(-(wanted.agg(F.sum("n")).first()[0] or 0) // TASK_SHINGLES))
    links = room.keep(confirm(docs, wanted, n_tasks), "links")
    group = components(links, room, "groups").withColumnsRenamed({"id": "cid"})
    grouped = numbered.join(group, "cid").select("cid", "node", "component", "doc_id")
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("least"))
    joined = grouped.join(least, "component").select("node", "least")
    own = numbered.select("node", F.col("doc_id").alias("own")).join(joined, "node", "left").select("node", F.coalesce("least", "own").alias("component_id"))
    rows = sketched.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(own, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | component.eqNullSafe(F.col("doc_id"))).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op6_minhash": op6_minhash}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: All pairs of documents that share a shingle, by the words themselves, and all that is reachable.
ORACLES = {
    "op6_minhash": f"""
with recursive word as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
shingle as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from word where len(w) > 0)),
size as materialized (select doc_id, count(*) as n from shingle group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as materialized (select a, b from shared join size x on x.doc_id = a join size y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
step as materialized (select a, b from link union all select b, a from link),
reach as (select doc_id as a, doc_id as b from size union select reach.a, step.b from reach join step on step.a = reach.b),
least as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept
from documents left join size using (doc_id) left join least using (doc_id)"""
}
