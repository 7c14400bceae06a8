"""Removal of repeated byte strings by a sampled suffix array.

A byte goes when a string of LENGTH bytes that covers it also starts earlier: in a document with a smaller id, or before
in the same one. Sorting a suffix for every byte would move the corpus many times over, so suffixes are sampled: of each
string of LENGTH bytes the GRAM-byte string with the least hash is an anchor. Equal strings have their anchor at the same
place, so suffixes at anchors, with the bytes to their left, are enough for an exact result:

1. anchors are counted by hash, pre-aggregated in each task; only those that occur again go on;
2. their suffixes, cut to what a string of LENGTH bytes can reach, are dealt by sampled splitters over their leading bytes,
   so that all with the same first GRAM bytes meet; a bucket sorts them by multikey quicksort to the right and to the left,
   and common prefixes of neighbours give for each offset which strings are equal and which of them is first;
3. spans go back to their documents, and overlapping ones are merged.

A string that occurs very often would fill a bucket. Copies within a task are settled there, so an unchanging surrounding
costs a row per task. An anchor that occurs more than HOT times is replaced by the suffixes of all strings around it, dealt
by a hash of all LENGTH bytes: these strings need to meet their equals only. All comparisons are on bytes, so no path marks
a string that isn't repeated. Whole copies of a document are found first by their digest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.blobs import FREQUENT, REPEAT, ROWS, SAMPLE, blob_rows, bucket_of, by_part, dealt_keys, first_of, mixed, pack, passed, settled_keys, texts_of, unpack
from tesserae.llm.columns import free, named
from tesserae.llm.scratch import Scratch

LENGTH, GRAM = 100, 40
#: Anchors beyond which a leading string is dealt out by whole strings: so many at least, and one in so many of all anchors, so
#: that no more than HOT_SHARE leading strings can be hot, whatever the corpus.
HOT, HOT_SHARE = 30_000, 2_000_000
#: Least and most text bytes of a group of documents, and of the text whose suffixes a bucket has on average.
LEAST_BYTES, MOST_BYTES = 6 << 20, 128 << 20
#: Text bytes of a group for each bucket: groups and buckets grow with the root of the corpus, so that what a group has for a bucket doesn't shrink to a few rows.
SHARE = 2048
#: Anchors that a task gathers before it hands them on, windows hashed at once, and rows of surroundings made at once.
FLUSH, PIECE, STEP = 1 << 20, 1 << 19, 1 << 14
#: One in so many anchors is a sample for splitters, and fewer where that would be over SAMPLES.
SAMPLED, SAMPLES = 4096, 1_000_000
#: Leading bytes of splitters: those that equal strings share at their anchor, so that only one repeated string can't be cut.
LEAD = GRAM
SPANS = "array<struct<start: long, end: long>>"

_RNG = np.random.default_rng(20)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = _RNG.integers(1, 1 << 63, LENGTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)

def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of each string of gram bytes, from those of strings of 1, 2, 4, ... bytes: the byte at j counts _BASE to the power gram - 1 - j."""
    part, size = _TABLE[data], 1
    whole, done = None, 0
    n = len(data) - gram + 1
    while True:
        power = np.uint64(pow(int(_BASE), size, 1 << 64))
        if gram & size:
            whole = part[:n] if whole is None else whole * power + part[done : done + n]
            done += size
        if 2 * size > gram:
            return mixed(whole)
        part = part[:-size] * power + part[size:]
        size *= 2


def gram_hash_rows(rows: np.ndarray) -> np.ndarray:
    """What gram_hashes gives for each row of bytes."""
    powers = np.array([pow(int(_BASE), rows.shape[1] - 1 - j, 1 << 64) for j in range(rows.shape[1])], np.uint64)
    return mixed(_TABLE[rows] @ powers)


def rows_hash(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes; their number is a multiple of 8."""
    words = np.ascontiguousarray(rows).view(np.uint64)
    return mixed(mixed(words * _WEIGHTS[: words.shape[1]]).sum(axis=1))


def anchors(data: np.ndarray, bounds: list[tuple[int, int]], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of length bytes that lie within one of bounds; the leftmost of equals."""
    windows = length - gram + 1
    valid = np.zeros(max(0, len(data) - length + 1), dtype=bool)
    for begin, end in bounds:
        valid[begin : max(begin, end - length + 1)] = True
    if not valid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = gram_hashes(data, gram)
    least = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= windows:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < windows:
        rest = windows - size
        least = np.minimum(least[: len(least) - rest], least[rest:])
    at = (least[valid] & _LOW).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, hashes[at]


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Texts side by side, a few at a time and long ones in overlapping pieces: bytes, bounds, text numbers and offsets of the pieces."""
    parts, bounds, which, shift, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[a : a + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            parts.append(part)
            bounds.append((size, size + len(part)))
            which.append(i)
            shift.append(a - size)
            size += len(part)
            if size >= PIECE:
                yield np.frombuffer(b"".join(parts), np.uint8), bounds, np.array(which), np.array(shift)
                parts, bounds, which, shift, size = [], [], [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), bounds, np.array(which), np.array(shift)


def find_anchors(docs: DataFrame, n_parts: int, sampled: int) -> DataFrame:
    """Anchors of docs (part, doc, text) for settle_anchors: one of each hash by its bucket, the others, which are repeated for sure, by their documents' part."""

    def told(held: list[tuple[np.ndarray, ...]], leads: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows = dealt_keys(*(np.concatenate(c) for c in zip(*held, strict=True)), n_parts)
        h, lead = (np.concatenate(c) for c in zip(*leads, strict=True))
        return blob_rows(rows + [(b, SAMPLE, pack(**c)) for b, c in by_part(bucket_of(h, n_parts), h=h, lead=lead)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leads, size = [], [], 0
        for batch in batches:
            homes, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, bounds, which, shift in _pieces(texts_of(batch.column(2))):
                at, h = anchors(data, bounds)
                piece = np.searchsorted([b for b, _ in bounds], at, side="right") - 1
                held.append((h, ids[which[piece]], at + shift[piece], homes[which[piece]]))
                taken = h % np.uint64(sampled) == 0
                leads.append((h[taken], np.lib.stride_tricks.sliding_window_view(data, LEAD)[at[taken]]))
                size += len(at)
                if size >= FLUSH:
                    yield told(held, leads)
                    held, leads, size = [], [], 0
        if held:
            yield told(held, leads)

    return docs.select("part", "doc", "text").mapInArrow(run, ROWS)


def settle_anchors(found: DataFrame, n_parts: int, most: int) -> DataFrame:
    """Places of repeated anchors by their documents' part; hashes of frequent ones; leading bytes of sampled ones."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part, kinds = key[0].as_py(), rows.column("kind").to_numpy()
        if part >= n_parts:
            return passed(rows, part - n_parts)
        blobs = rows.column("data").to_pylist()
        own = unpack([b for b, k in zip(blobs, kinds, strict=True) if k == REPEAT])
        out, again = settled_keys(own, most)
        told = unpack([b for b, k in zip(blobs, kinds, strict=True) if k == SAMPLE])
        if told:
            lead = told["lead"][np.isin(told["h"], again)]
            if len(lead):
                out.append((-1, SAMPLE, pack(lead=lead)))
        return pa.Table.from_batches([blob_rows(out)])

    return found.groupBy("part").applyInArrow(run, ROWS)


def _strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings that compare in order; zero bytes at an end don't count."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def splitters(leads: np.ndarray, n: int) -> np.ndarray:
    """n - 1 leading strings that cut a sample evenly; fewer where strings repeat. One string counts for one bucket at most, as
    a sample has all or none of its places."""
    if not len(leads):
        return np.zeros(0, f"S{LEAD}")
    names, count = np.unique(_strings(leads), return_counts=True)
    while count.max() > max(1, count.sum() // n):
        count = np.minimum(count, max(1, count.sum() // n))
    upto = np.cumsum(count)
    return np.unique(names[np.searchsorted(upto, upto[-1] * np.arange(1, n) // n, side="right")])


def surroundings(texts: dict[int, bytes], doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of doc, pos and the bytes from LENGTH - GRAM before to LENGTH after it, zeros beyond the text, with how many there are on each side."""
    before = LENGTH - GRAM
    spare = bytes(LENGTH)
    for i in range(0, len(doc), STEP):
        d, p = doc[i : i + STEP], pos[i : i + STEP]
        ids, where = np.unique(d, return_inverse=True)
        sizes = np.array([len(texts[x]) for x in ids.tolist()])
        base = np.concatenate([[0], np.cumsum(sizes + LENGTH)[:-1]]) + LENGTH
        data = np.frombuffer(spare + b"".join(texts[x] + spare for x in ids.tolist()), np.uint8)
        around = data[(base[where] + p)[:, None] + np.arange(-before, LENGTH)]
        left, right = np.minimum(p, before), np.minimum(sizes[where] - p, LENGTH)
        yield d, p, around, left.astype(np.uint8), right.astype(np.uint8)


def _taken(rows: dict[str, np.ndarray], some: np.ndarray) -> dict[str, np.ndarray]:
    return {k: c[some] for k, c in rows.items()}


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def strings_around(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each string of LENGTH bytes around an anchor as a row of its own, with nothing to its left, in order of document and place."""
    before, out = LENGTH - GRAM, []
    for offset in range(before + 1):
        some = _taken(rows, (rows["left"] >= offset) & (rows["right"] >= LENGTH - offset))
        text = np.zeros_like(some["text"])
        text[:, before:] = some["text"][:, before - offset : before - offset + LENGTH]
        out.append(some | {"pos": some["pos"] - offset, "text": text, "left": np.zeros_like(some["left"]), "right": np.full_like(some["right"], LENGTH)})
    every = _joined(out)
    return _taken(every, np.lexsort((every["pos"], every["doc"])))


def settled(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Rows, in order of document and place, whose surrounding is that of one before, and the others. A place that comes twice stays once."""
    h = rows_hash(rows["text"]) + mixed(rows["left"].astype(np.uint64) * np.uint64(256) + rows["right"].astype(np.uint64))
    first, _ = first_of(h)
    same = (first != np.arange(len(first))) & (rows["left"] == rows["left"][first]) & (rows["right"] == rows["right"][first])
    at = np.flatnonzero(same)
    for i in range(0, len(at), STEP):
        part = at[i : i + STEP]
        same[part] = (rows["text"][part] == rows["text"][first[part]]).all(axis=1)
    elsewhere = (rows["doc"] != rows["doc"][first]) | (rows["pos"] != rows["pos"][first])
    return _taken(rows, same & elsewhere), _taken(rows, ~same)


def find_suffixes(docs: DataFrame, repeats: DataFrame, n_parts: int, cuts: np.ndarray, frequent: np.ndarray) -> DataFrame:
    """Suffixes at repeated anchors for settle_suffixes, by bucket; spans of those whose whole surrounding occurs before in the same group, by part."""
    before = LENGTH - GRAM

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        own = unpack(right.column("data").to_pylist())
        if not own or not len(left):
            return pa.Table.from_batches([blob_rows(out)])
        part = key[0].as_py()

        def kept(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            same, rest = settled(rows)
            same = _taken(same, same["left"].astype(np.int64) + same["right"] >= LENGTH)
            if len(same["doc"]):
                out.append((n_parts + part, REPEAT, pack(doc=same["doc"], start=same["pos"] - same["left"], end=same["pos"] + same["right"])))
            return rest

        def dealt(bucket: np.ndarray, rows: dict[str, np.ndarray]) -> None:
            out.extend((b, REPEAT, pack(**c, home=np.full(len(c["doc"]), part, np.int32))) for b, c in by_part(bucket, **rows))

        texts = dict(zip(left.column("doc").to_pylist(), texts_of(left.column("text")), strict=True))
        order = np.lexsort((own["pos"], own["doc"]))
        names = ("doc", "pos", "text", "left", "right")
        rows = kept(_joined([kept(dict(zip(names, x, strict=True))) for x in surroundings(texts, own["doc"][order], own["pos"][order])]))
        hot = np.concatenate([np.isin(gram_hash_rows(rows["text"][i : i + STEP, before : before + GRAM]), frequent) for i in range(0, len(rows["doc"]), STEP)])
        calm, hot = _taken(rows, ~hot), _taken(rows, hot)
        dealt(np.searchsorted(cuts, _strings(calm["text"][:, before : before + LEAD]), side="right"), calm)
        for i in range(0, len(hot["doc"]), STEP // 8):
            every = kept(strings_around(_taken(hot, np.arange(i, min(i + STEP // 8, len(hot["doc"]))))))
            dealt(bucket_of(rows_hash(every["text"]), n_parts), every)
        return pa.Table.from_batches([blob_rows(out)])

    return docs.groupBy("part").cogroup(repeats.groupBy("part")).applyInArrow(run, ROWS)


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of rows of 8-byte words: rows are split by a word at a time, and only those that are still equal by the next."""
    n, width = words.shape
    order, group = np.arange(n), np.zeros(n, np.int64)
    open_ = np.arange(n)
    for j in range(width):
        if len(open_) < 2:
            break
        rows = order[open_]
        by = np.lexsort((words[rows, j], group[open_]))
        order[open_] = rows[by]
        own, value = group[open_], words[order[open_], j]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])])
        group[open_] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(open_)]]))
        open_ = open_[np.repeat(size > 1, size)]
    return order


def _shared(rows: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The common prefix of each row with the one before in order; that of the first is 0."""
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 1 << 16):
        a, b = order[i - 1 : i - 1 + (1 << 16)][: len(order) - i], order[i : i + (1 << 16)]
        differs = rows[a] != rows[b]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        out[i : i + (1 << 16)] = np.minimum(first, np.minimum(size[a], size[b]))
    return out


def _words(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def repeated(doc: np.ndarray, pos: np.ndarray, text: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of the spans around anchors that occur earlier among the given ones."""
    before = LENGTH - GRAM
    order = np.lexsort((pos, doc))
    doc, pos, text, left, right = doc[order], pos[order], text[order], left[order].astype(np.int64), right[order].astype(np.int64)
    ahead, back = text[:, before:], text[:, before - 1 :: -1]
    by_right, by_left = multikey_sort(_words(ahead)), multikey_sort(_words(back))
    prefix, suffix = _shared(ahead, by_right, right), _shared(back, by_left, left)
    n = len(pos)
    marked = np.zeros((n, before + 1), bool)
    classes = np.empty((2, n), np.int64)
    for offset in range(before + 1):
        some = (left >= offset) & (right >= LENGTH - offset)
        if not some.any():
            continue
        for side, (by, common, depth) in enumerate(((by_right, prefix, LENGTH - offset), (by_left, suffix, offset))):
            classes[side, by] = np.cumsum(common < depth)
            some &= np.bincount(classes[side])[classes[side]] > 1
        at = np.flatnonzero(some)
        first, _ = first_of(classes[0, at] * (n + 1) + classes[1, at])
        other = at[first]
        marked[at[(doc[at] != doc[other]) | (pos[at] != pos[other])], offset] = True
    edge = np.zeros((n, before + 3), np.int8)
    edge[:, 1:-1] = marked
    step = np.diff(edge, axis=1)
    row, low = np.nonzero(step == 1)
    high = np.nonzero(step == -1)[1] - 1
    return order[row], pos[row] - high, pos[row] - low + LENGTH


def settle_suffixes(found: DataFrame, n_parts: int) -> DataFrame:
    """Spans by their documents' part."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part >= n_parts:
            return passed(rows, part - n_parts)
        own = unpack(rows.column("data").to_pylist())
        row, start, end = repeated(own["doc"], own["pos"], own["text"], own["left"], own["right"])
        return pa.Table.from_batches([blob_rows([(p, REPEAT, pack(**c)) for p, c in by_part(own["home"][row], doc=own["doc"][row], start=start, end=end)])])

    return found.groupBy("part").applyInArrow(run, ROWS)


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return list(zip(start[new].tolist(), reach[last].tolist(), strict=True))


def widened(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with all bytes of the UTF-8 characters that they hold a byte of; overlapping ones are merged."""
    out: list[tuple[int, int]] = []
    for a, b in runs:
        while a > 0 and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def gathered_spans(spans: DataFrame) -> DataFrame:
    """doc and its maximal runs of removed bytes, of spans (part, data)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own = unpack(rows.column("data").to_pylist())
        doc = own.get("doc", np.zeros(0, np.int64))
        order = np.argsort(doc, kind="stable")
        doc, start, end = doc[order], own.get("start", doc)[order], own.get("end", doc)[order]
        ids, cuts = np.unique(doc, return_index=True)
        runs = [[{"start": a, "end": b} for a, b in merged(start[i:j], end[i:j])] for i, j in zip(cuts, [*cuts[1:], len(doc)], strict=True)]
        return pa.table({"doc": pa.array(ids, pa.int64()), "spans": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return spans.groupBy("part").applyInArrow(run, f"doc long, spans {SPANS}")


def cut_out(characters: bool) -> Any:
    """A function of a text and its spans: the bytes that stay, and the spans that go; with characters, these are whole ones."""

    @F.pandas_udf(f"kept binary, removed {SPANS}")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        kept, gone = [], []
        for text, own in zip(texts, spans, strict=True):
            if own is None:
                kept.append(None)
                gone.append(None)
                continue
            data, runs = text.encode("utf-8"), [(int(s["start"]), int(s["end"])) for s in own]
            if characters:
                runs = widened(data, runs)
            at, parts = 0, []
            for a, b in runs:
                parts.append(data[at:a])
                at = b
            kept.append(b"".join([*parts, data[at:]]))
            gone.append([{"start": a, "end": b} for a, b in runs])
        return pd.DataFrame({"kept": pd.Series(kept, dtype=object), "removed": pd.Series(gone, dtype=object)})

    return cut


def _numbered(docs: DataFrame, room: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text) as (doc, text) with unique doc in order of doc_id, and the doc of each doc_id and digest of a text; None if doc_id is unique.

    Rows of a repeated doc_id are documents in the order of a digest of their texts, and null ids come last."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), None
    names = docs.select(F.col("doc_id").alias("id"), _digest(F.col("text")).alias("digest")).distinct().orderBy(F.col("id").asc_nulls_last(), "digest")
    names = room.keep(names.withColumn("doc", F.monotonically_increasing_id()), "names")
    own = docs.select("doc_id", _digest(F.col("text")).alias("own"), "text").join(names, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")))
    return room.keep(own.groupBy("doc").agg(F.first("text").alias("text")), "numbered"), names


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def remove_repeats(spark: SparkSession, docs: DataFrame, characters: bool = False) -> DataFrame:
    """Each row of docs (doc_id, text, others) with kept (bytes) and removed (spans of bytes) instead of text. With characters,
    a character that a span holds a byte of goes whole.

    A null text is empty. Rows of the same doc_id and text are one document: each of them gets its result; rows of the
    same doc_id and other texts are documents in the order of a hash of their texts. Null ids come last. Other columns stay
    as they are, of whatever kind, and are only joined; where one is called kept or removed, the result's is the next free name
    of kept_1, kept_2 and so on. The input is read three times; texts are shuffled to their group of LEAST_BYTES to MOST_BYTES
    once, and with the other columns to their spans.
    """
    room = Scratch(spark, "suffixes")
    whole = docs
    docs, names = _numbered(docs.select("doc_id", "text"), room)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    size = F.octet_length("text")
    keyed = room.keep(docs.select("doc", size.cast("long").alias("n"), _digest(F.col("text")).alias("digest")), "digests")
    total = keyed.agg(F.sum("n")).first()[0] or 0
    n_groups = n_parts = max(1, -(-total // min(MOST_BYTES, max(LEAST_BYTES, math.isqrt(total * SHARE)))))
    part = F.pmod(F.xxhash64("doc"), F.lit(n_groups)).cast("int").alias("part")
    long = keyed.where(F.col("n") >= LENGTH)
    firsts = long.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest", "first")
    copies = room.keep(long.join(firsts, "digest").where("doc > first").select("doc", "n"), "copies")

    grouped = docs.select(part, "doc", "text")
    fresh = grouped.where(F.octet_length("text") >= LENGTH).join(copies.select("doc"), "doc", "left_anti").select("part", "doc", "text")
    n_anchors = 2 * total // (LENGTH - GRAM)  # about
    found = find_anchors(fresh, n_parts, max(SAMPLED, n_anchors // SAMPLES))
    found = room.keep(settle_anchors(found, n_parts, max(HOT, n_anchors // HOT_SHARE)), "anchors")
    # About HOT_SHARE leading strings and SAMPLES at most.
    told = {kind: unpack([bytes(r["data"]) for r in found.where(F.col("kind") == kind).select("data").collect()]) for kind in (FREQUENT, SAMPLE)}
    cuts = splitters(told[SAMPLE].get("lead", np.zeros((0, LEAD), np.uint8)), n_parts)
    frequent = told[FREQUENT].get("h", np.zeros(0, np.uint64))
    repeats = found.where(F.col("kind") == REPEAT).select("part", "data")
    spans = room.keep(settle_suffixes(find_suffixes(grouped, repeats, n_parts, cuts, frequent), n_parts).select("part", "data"), "spans")
    room.drop("anchors")

    gone = copies.select("doc", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))).cast(SPANS).alias("spans"))
    of_doc = room.keep(gathered_spans(spans).join(gone.select("doc"), "doc", "left_anti").unionByName(gone), "removed")
    room.drop("spans")
    taken = list(whole.columns)
    if names is None:
        own = [free(taken, "doc"), free(taken, "spans")]
        both = whole.join(of_doc.toDF(*own), F.col("doc_id").cast("long") == F.col(own[0]), "left")
    else:
        own = [free(taken, "id"), free(taken, "digest"), free(taken, "spans")]
        of_row = names.join(of_doc, "doc").select("id", "digest", "spans").toDF(*own)
        both = whole.join(of_row, F.col("doc_id").eqNullSafe(F.col(own[0])) & (_digest(F.col("text")) == F.col(own[1])), "left")
    cut, spans = free(taken, "cut"), F.col(own[-1])
    both = both.select("*", cut_out(characters)(F.when(spans.isNotNull(), F.coalesce("text", F.lit(""))), spans).alias(cut))
    kept = F.coalesce(F.col(f"{cut}.kept"), F.coalesce("text", F.lit("")).cast("binary"))
    removed = F.coalesce(F.col(f"{cut}.removed"), F.array().cast(SPANS))
    others = [named(c) for c in taken if c not in ("doc_id", "text")]
    return both.select("doc_id", kept.alias(free(taken, "kept")), removed.alias(free(taken, "removed")), *others)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    lost = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long"))
    return found.select("doc_id", (F.octet_length("kept") + lost).cast("long").alias("n_bytes"), lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_suffixes": op8_suffixes}

#: All strings of 100 bytes, as hex digits; runs of bytes by gaps between them.
ORACLES = {
    "op8_suffixes": """
with h as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
start as (select doc_id, i, substr(h, 2 * i + 1, 200) as s from (select doc_id, h, unnest(range(len(h) // 2 - 99)) as i from h where len(h) >= 200)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as n from start) where n > 1),
run as (select doc_id, min(i) as a, max(i) + 100 as b from (select *, sum(case when i <= before + 100 then 0 else 1 end) over (partition by doc_id order by i) as g
        from (select *, coalesce(lag(i) over (partition by doc_id order by i), -1000) as before from later)) group by doc_id, g),
edge as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as begun, row_number() over (partition by doc_id order by a desc) as last from run),
part as (select doc_id, a as place, substr(h, 2 * begun + 1, 2 * (a - begun)) as s from edge join h using (doc_id)
         union all select doc_id, len(h) as place, substr(h, 2 * coalesce(b, 0) + 1) as s from h left join (select * from edge where last = 1) e using (doc_id)),
kept as (select doc_id, string_agg(s, '' order by place) as k from part group by doc_id),
total as (select doc_id, count(*) as n, sum(b - a) as removed from run group by doc_id)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans, sha256(unhex(k)) as kept_sha256
from h join kept using (doc_id) left join total using (doc_id)"""
}
