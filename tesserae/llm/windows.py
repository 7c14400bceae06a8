"""Removal of word windows that an earlier document has, with a count-min sketch before the exact grouping.

A word goes when a window of WORDS words that covers it also starts in a document with a smaller id. Most windows occur once, so
they are counted roughly first:

1. documents are dealt to groups by a hash. A group makes a partition sketch: ROWS_OF_SKETCH cells for each distinct window, and
   whether more than one document of the group counts there. The sketch is as wide as the corpus has windows, so it is cut into
   segments and a group's part of one is a list of cells, not a table. A segment adds up the lists of all groups, and tells each
   group which of its cells are counted twice or more, a bit for each;
2. a group estimates each window by the least of its cells. A window that two documents have is counted twice in all of them, so
   none is lost; the others that are estimated as repeated are few. Only these go on: one row of each distinct window of a group,
   with the smallest id there, to the bucket of its hash of 128 bits, which finds the smallest of all and answers a bit;
3. with these bits a group knows the windows that occur earlier, and their words go from the documents.

A group sends a window once, so a passage of very many documents is one row for each group. Whole copies of a text are found
before, by their digest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.audit import portions
from tesserae.llm.blobs import ROWS, blob_rows, bucket_of, by_part, mixed, pack, passed, unpack
from tesserae.llm.columns import free, named
from tesserae.llm.scratch import Scratch

#: Words of a window, and bytes of a text that can have one.
WORDS, LEAST_TEXT = 50, 99
#: Rows of the sketch: cells that a window is counted in.
ROWS_OF_SKETCH = 2
#: Least and most text bytes of a group, and of a group for each segment: groups and segments grow with the root of the corpus.
LEAST_BYTES, MOST_BYTES, SHARE = 6 << 20, 64 << 20, 2048
#: Windows that are hashed at once.
STEP = 1 << 19
#: Kinds of rows: windows for a bucket, runs that go for sure, runs that wait for a bucket's answer, the buckets of these windows, and answers; a whole copy.
KEYS, SURE, WAITING, BUCKETS, ANSWER, COPY = *range(5), -1
SPANS = "array<struct<start: long, end: long>>"

_BASES = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word of the texts, as two numbers, and how many words each text has."""
    found, sizes = [np.zeros((0, 2), np.uint64)], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    which: list[int] = []
    size = 0

    def flush() -> None:
        words = pc.ascii_split_whitespace(pa.array(held, pa.binary()).cast(pa.string()))
        flat = words.flatten()
        some = np.asarray(pc.greater(pc.binary_length(flat), 0))
        np.add.at(sizes, np.repeat(which, np.diff(words.offsets.to_numpy()))[some], 1)
        coded = flat.filter(pa.array(some)).dictionary_encode()
        own = b"".join(blake2b(w.encode("utf-8"), digest_size=16).digest() for w in coded.dictionary.to_pylist())
        found.append(np.frombuffer(own, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()])
        held.clear()
        which.clear()

    for i, text in enumerate(texts):
        for part in portions(text):
            held.append(part)
            which.append(i)
            size += len(part)
            if size >= STEP:
                flush()
                size = 0
    if held:
        flush()
    return np.concatenate(found), sizes


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """128 bits of each string of n words, as two numbers, from those of strings of 1, 2, 4, ... words."""
    part, size = words, 1
    whole, done = None, 0
    while True:
        power = np.array([pow(int(b), size, 1 << 64) for b in _BASES], np.uint64)
        if n & size:
            whole = part[: len(words) - n + 1] if whole is None else whole * power + part[done : done + len(words) - n + 1]
            done += size
        if 2 * size > n:
            return mixed(whole)
        part = part[:-size] * power + part[size:]
        size *= 2


class Windows:
    """The windows of a group's documents, which come in order of rank: hashes (two numbers), document and place of each."""

    def __init__(self, texts: list[bytes]) -> None:
        words, sizes = word_hashes(texts)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        each = np.maximum(sizes - WORDS + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), each)
        self.pos = np.arange(len(self.doc)) - np.repeat(np.cumsum(each) - each, each)
        at = begins[self.doc] + self.pos
        hashes = [np.zeros((0, 2), np.uint64)]
        for i in range(0, len(words) - WORDS + 1, STEP):
            some = at[np.searchsorted(at, i) : np.searchsorted(at, i + STEP)]
            if len(some):
                hashes.append(window_hashes(words[i : i + STEP + WORDS - 1], WORDS)[some - i])
        self.hashes = np.concatenate(hashes)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of equal rows."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = ordered[1:] != ordered[:-1]
    cuts = np.flatnonzero(new.any(axis=1) if new.ndim == 2 else new) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ordered)]])


def cells_of(h: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cells of windows in a row of their segment; width is a power of 2."""
    return (mixed(h + _BASES[row]) & np.uint64(width - 1)).astype(np.int64)


def distinct(windows: Windows, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first number of each distinct window, ascending, whether more than one rank has it, and which of them each of windows is."""
    h = windows.hashes[:, 0]
    order = np.argsort(h, kind="stable")
    begin, end = _runs(h[order])
    own = ranks[windows.doc[order]]
    number = np.empty(len(h), np.int64)
    number[order] = np.repeat(np.arange(len(begin)), end - begin)
    return h[order[begin]], own[begin] != own[end - 1], number


def sketch(hashes: np.ndarray, many: np.ndarray, n_parts: int, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A group's part of the sketch: segment, row, ascending cells, whether two or more count there, and the numbers of the windows of the segment with their cells'.

    It depends on the group's documents only, so that a bit for each cell is enough for an answer."""
    for segment, c in by_part(bucket_of(hashes, n_parts), h=hashes, many=many, number=np.arange(len(hashes))):
        for row in range(ROWS_OF_SKETCH):
            cells, inverse, count = np.unique(cells_of(c["h"], row, width), return_inverse=True, return_counts=True)
            twice = count > 1
            twice[inverse[c["many"]]] = True
            yield segment, row, cells, twice, c["number"], inverse


def _planes(cells: np.ndarray) -> dict[str, np.ndarray]:
    """Ascending cells as bytes of their steps, the four bytes apart, which compresses well."""
    steps = np.diff(cells, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return {f"b{k}": steps[:, k] for k in range(4)}


def _cells(planes: dict[str, np.ndarray]) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.stack([planes[f"b{k}"] for k in range(4)], axis=1)).view("<u4").ravel().astype(np.int64))


def _group(docs: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray, Windows]:
    """doc, rank and windows of a group's documents (part, doc, rank, text) in order, without those that told (part, kind, data) has as copies."""
    doc, rank = docs.column("doc").to_numpy(), docs.column("rank").to_numpy()
    copies = [int(x.as_py()) for x, k in zip(told.column("data"), told.column("kind").to_pylist(), strict=True) if k == COPY]
    order = np.lexsort((doc, rank))
    order = order[~np.isin(doc[order], np.array(copies, np.int64))]
    text = docs.column("text")
    return doc[order], rank[order], Windows([text[int(i)].as_py().encode("utf-8") for i in order])


def find_cells(docs: DataFrame, copies: DataFrame, n_parts: int, width: int) -> DataFrame:
    """Partition sketches of groups (part, doc, rank, text) without copies, by segment; kind is the group and the row."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        home, (_, ranks, windows) = key[0].as_py(), _group(left, right)
        hashes, many, _ = distinct(windows, ranks)
        found = sketch(hashes, many, n_parts, width)
        return pa.Table.from_batches([blob_rows([(segment, home * ROWS_OF_SKETCH + row, pack(**_planes(cells), twice=twice)) for segment, row, cells, twice, _, _ in found])])

    return docs.groupBy("part").cogroup(copies.groupBy("part")).applyInArrow(run, ROWS)


def settle_cells(found: DataFrame, width: int) -> DataFrame:
    """Of the merged sketch, by group: a bit for each of its cells in a segment and row, whether it counts two or more; kind is the segment and the row."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        segment, kinds = key[0].as_py(), rows.column("kind").to_pylist()
        out = []
        for row in range(ROWS_OF_SKETCH):
            own = [(k // ROWS_OF_SKETCH, i) for i, k in enumerate(kinds) if k % ROWS_OF_SKETCH == row]
            table = np.zeros(width, np.uint8)
            for _, i in own:
                part = unpack([rows.column("data")[i].as_py()])
                cells = _cells(part)
                table[cells] = np.minimum(table[cells] + 1 + part["twice"], 2)
            for home, i in own:
                bits = table[_cells(unpack([rows.column("data")[i].as_py()]))] > 1
                out.append((home, segment * ROWS_OF_SKETCH + row, pack(bits=np.packbits(bits))))
        return pa.Table.from_batches([blob_rows(out)])

    return found.groupBy("part").applyInArrow(run, ROWS)


def _joined_runs(doc: np.ndarray, *steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of one doc in which each of steps goes up by one."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = doc[1:] != doc[:-1]
    for s in steps:
        new |= s[1:] != s[:-1] + 1
    cuts = np.flatnonzero(new) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(doc)]])


def find_windows(docs: DataFrame, answers: DataFrame, n_parts: int, width: int) -> DataFrame:
    """The windows that the sketch estimates as repeated, by bucket: one row of each in a group; runs of windows of the group by n_parts and its part."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if not len(left):
            return pa.Table.from_batches([blob_rows(out)])
        part = key[0].as_py()
        ids, ranks, windows = _group(left, right)
        bits = dict(zip(right.column("kind").to_pylist(), right.column("data").to_pylist(), strict=True))
        own, many, number = distinct(windows, ranks)
        estimate = np.ones(len(own), bool)
        for segment, row, cells, _, some, inverse in sketch(own, many, n_parts, width):
            told = np.unpackbits(unpack([bits[segment * ROWS_OF_SKETCH + row]])["bits"], count=len(cells)).astype(bool)
            estimate[some] &= told[inverse]
        at = np.flatnonzero(estimate[number])
        doc, pos, hashes = windows.doc[at], windows.pos[at], windows.hashes[at]
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))  # stable: in order of rank and place
        begin, end = _runs(hashes[order])
        first = order[begin]
        by_place = np.argsort(first)  # windows are numbered by their first place
        name = np.empty(len(begin), np.int64)
        name[by_place] = np.arange(len(begin))
        names, lowest = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        names[order], lowest[order] = np.repeat(name, end - begin), np.repeat(ranks[doc[first]], end - begin)
        first = first[by_place]
        bucket = bucket_of(hashes[first, 0], n_parts)
        sure = ranks[doc] > lowest
        out.extend((b, KEYS, pack(home=np.full(len(c["rank"]), part, np.int32), **c)) for b, c in by_part(bucket, h1=hashes[first, 0], h2=hashes[first, 1], rank=ranks[doc[first]]))
        if len(first):
            out.append((n_parts + part, BUCKETS, pack(bucket=bucket.astype(np.int32))))
        for kind, some in ((SURE, sure), (WAITING, ~sure)):
            d, p, n = doc[some], pos[some], names[some]
            i, j = _joined_runs(d, p, *([n] if kind == WAITING else []))
            if len(i):
                out.append((n_parts + part, kind, pack(doc=ids[d[i]], pos=p[i], name=n[i], n=j - i)))
        return pa.Table.from_batches([blob_rows(out)])

    return docs.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, ROWS)


def settle_windows(found: DataFrame, n_parts: int) -> DataFrame:
    """By group: for each bucket a bit for each window sent to it, whether a smaller rank has it elsewhere; a group's own rows as they are."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part >= n_parts:
            return passed(rows, part - n_parts)
        own = unpack(rows.column("data").to_pylist())
        order = np.lexsort((own["rank"], own["h2"], own["h1"]))
        begin, end = _runs(np.stack([own["h1"], own["h2"]], axis=1)[order])
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(own["rank"][order[begin]], end - begin)
        earlier = least < own["rank"]
        return pa.Table.from_batches([blob_rows([(home, ANSWER, pack(bucket=np.full(len(c["bits"]), part, np.int32), **c)) for home, c in by_part(own["home"], bits=earlier)])])

    return found.groupBy("part").applyInArrow(run, ROWS)


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... n times each."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def removed_words(found: DataFrame) -> DataFrame:
    """doc and its maximal runs of words that go."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        kinds, blobs = rows.column("kind").to_pylist(), rows.column("data").to_pylist()
        sure, waiting, buckets, answers = (unpack([b for b, k in zip(blobs, kinds, strict=True) if k == kind]) for kind in (SURE, WAITING, BUCKETS, ANSWER))
        parts = [(sure["doc"], sure["pos"], sure["n"])] if sure else []
        if waiting:
            told = np.zeros(len(buckets["bucket"]), bool)
            told[np.argsort(buckets["bucket"], kind="stable")] = answers["bits"][np.argsort(answers["bucket"], kind="stable")]
            some = told[_spread(waiting["name"], waiting["n"])]
            doc, pos = np.repeat(waiting["doc"], waiting["n"])[some], _spread(waiting["pos"], waiting["n"])[some]
            i, j = _joined_runs(doc, pos)
            parts.append((doc[i], pos[i], j - i))
        doc, begin, n = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order], (begin + n + WORDS - 1)[order]
        i, j = _runs(doc)
        spans = []
        for a, b in zip(i, j, strict=True):
            reach = np.maximum.accumulate(end[a:b])
            new = np.flatnonzero(np.concatenate([[True], begin[a + 1 : b] > reach[:-1]]))
            last = np.concatenate([new[1:] - 1, [b - a - 1]])
            spans.append([{"start": x, "end": y} for x, y in zip(begin[a:b][new].tolist(), reach[last].tolist(), strict=True)])
        return pa.table({"doc": pa.array(doc[i], pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return found.groupBy("part").applyInArrow(run, f"doc long, spans {SPANS}")


def cut_words(text: bytes, spans: list[tuple[int, int]] | None) -> tuple[str, int, int]:
    """The words that stay, joined by a space, and how many there are and go; None for spans that hold every word, if there are WORDS."""
    if spans is None:
        n = sum(len(part.split()) for part in portions(text))
        if n >= WORDS:
            return "", n, n
        spans = []
    kept: list[bytes] = []
    n, left = 0, spans
    for part in portions(text):
        words, at = part.split(), 0
        own: list[bytes] = []
        for a, b in left:
            if a >= n + len(words):
                break
            own += words[at : max(at, a - n)]
            at = min(max(at, b - n), len(words))
        own += words[at:]
        n += len(words)
        left = [(a, b) for a, b in left if b > n]
        if own:
            kept.append(b" ".join(own))
    return b" ".join(kept).decode("utf-8"), n, sum(b - a for a, b in spans)


def _cut() -> Any:
    """A function of a text, its spans and whether it is a copy: what cut_words gives."""

    @F.pandas_udf("kept string, n_words long, n_removed long")
    def cut(texts: pd.Series, spans: pd.Series, copies: pd.Series) -> pd.DataFrame:
        found = []
        for text, own, copy in zip(texts, spans, copies, strict=True):
            runs = None if copy else [(int(s["start"]), int(s["end"])) for s in own] if own is not None else []
            found.append(cut_words(text.encode("utf-8"), runs))
        return pd.DataFrame(found, columns=["kept", "n_words", "n_removed"])

    return cut


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _numbered(docs: DataFrame, room: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text) as doc, rank and text, where doc is a number of each pair of doc_id and text, and rank is equal for equal ids,
    in their order, null last; and the doc of each id and digest of a text, None where doc_id is unique."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("doc_id").cast("long").alias("rank"), "text"), None
    names = docs.select(F.col("doc_id").alias("id"), _digest(F.col("text")).alias("digest")).distinct().orderBy(F.col("id").asc_nulls_last(), "digest")
    names = room.keep(names.withColumn("doc", F.monotonically_increasing_id()), "unranked")
    ranks = names.groupBy("id").agg(F.min("doc").alias("rank")).withColumnRenamed("id", "of")
    names = room.keep(names.join(ranks, F.col("id").eqNullSafe(F.col("of"))).drop("of"), "names")
    own = docs.select("doc_id", _digest(F.col("text")).alias("own"), "text").join(names, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")))
    return room.keep(own.groupBy("doc").agg(F.min("rank").alias("rank"), F.first("text").alias("text")), "numbered"), names


def remove_repeated_windows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text, others) with kept (the words that stay, joined by a space), n_words and n_removed instead of text.

    Words are what white space of ASCII parts. A null text is empty, and a text of fewer than WORDS words loses none. Only windows of a
    smaller doc_id count: rows of one doc_id take nothing from each other, and null ids come last and are equal. Other columns stay as
    they are; where one is called kept, n_words or n_removed, the result's is the next free name of kept_1 and so on. Windows are
    told apart by 128 bits of a hash of their words."""
    room = Scratch(spark, "windows")
    whole = docs
    docs, names = _numbered(docs.select("doc_id", "text"), room)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    long = docs.where(F.octet_length("text") >= LEAST_TEXT)
    keyed = room.keep(long.select("doc", "rank", F.octet_length("text").cast("long").alias("n"), _digest(F.col("text")).alias("digest")), "digests")
    firsts = keyed.groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").drop("last")
    total = keyed.agg(F.sum("n")).first()[0] or 0
    n_parts = max(1, -(-total // min(MOST_BYTES, max(LEAST_BYTES, math.isqrt(total * SHARE)))))
    width = 1 << max(10, (total // n_parts).bit_length())
    part = F.pmod(F.xxhash64("doc"), F.lit(n_parts)).cast("int").alias("part")
    copies = room.keep(keyed.join(firsts, "digest").where("rank > first").select(part, F.lit(COPY).alias("kind"), F.col("doc").cast("string").cast("binary").alias("data"), "doc"), "copies")
    grouped, told = long.select(part, "doc", "rank", "text"), copies.drop("doc")

    answers = room.keep(settle_cells(find_cells(grouped, told, n_parts, width), width), "answers")
    found = room.keep(settle_windows(find_windows(grouped, answers.unionByName(told), n_parts, width), n_parts), "found")
    room.drop("answers")
    none = F.lit(None).cast(SPANS).alias("spans")
    of_doc = removed_words(found).withColumn("copy", F.lit(False)).unionByName(copies.select("doc", none, F.lit(True).alias("copy")))
    of_doc = room.keep(of_doc, "removed")
    room.drop("found")
    taken = list(whole.columns)
    if names is None:
        own = [free(taken, c) for c in ("doc", "spans", "copy")]
        both = whole.join(of_doc.toDF(*own).hint("merge"), F.col("doc_id").cast("long") == F.col(own[0]), "left")
    else:
        own = [free(taken, c) for c in ("id", "digest", "spans", "copy")]
        of_row = names.join(of_doc, "doc").select("id", "digest", "spans", "copy").toDF(*own)
        both = whole.join(of_row, F.col("doc_id").eqNullSafe(F.col(own[0])) & (_digest(F.col("text")) == F.col(own[1])), "left")
    cut = free(taken, "cut")
    both = both.select("*", _cut()(F.coalesce("text", F.lit("")), F.col(own[-2]), F.coalesce(F.col(own[-1]), F.lit(False))).alias(cut))
    others = [named(c) for c in taken if c not in ("doc_id", "text")]
    return both.select("doc_id", *(F.col(f"{cut}.{c}").alias(free(taken, c)) for c in ("kept", "n_words", "n_removed")), *others)


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_windows(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op12_windows": op12_windows}

#: All windows as lists of words.
ORACLES = {
    "op12_windows": r"""
with doc as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
start as (select doc_id, i, list_slice(w, i, i + 49) as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from doc where len(w) >= 50)),
later as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as first from start) where doc_id > first),
gone as (select distinct doc_id, i + k as i from (select doc_id, i, unnest(range(50)) as k from later)),
word as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from doc),
kept as (select word.doc_id, string_agg(word, ' ' order by i) as k from word anti join gone using (doc_id, i) group by 1),
lost as (select doc_id, count(*) as n from gone group by 1)
select doc.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from doc left join kept using (doc_id) left join lost using (doc_id)"""
}
