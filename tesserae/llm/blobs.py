"""Rows of numbers moved as compressed blobs, and counting of keys that occur again.

Millions of small rows for Python workers are cheaper as a blob for each pair of a task and a part than as rows of Spark,
which deals, sorts and spills the blobs all the same. A part is a group of documents or a bucket of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

ROWS = "part int, kind int, data binary"
REPEAT, FREQUENT, SAMPLE = 0, 1, 2


def pack(**columns: np.ndarray) -> bytes:
    """Columns of equal length as one compressed blob with a short head: names, types and widths."""
    head, body = [], []
    for name, c in columns.items():
        head.append(f"{name}:{c.dtype.str}:{c.shape[1] if c.ndim == 2 else 0}")
        body.append(np.ascontiguousarray(c).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([",".join(head).encode("ascii"), b"\0", *body]))


def unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of several blobs of the same kind, one after another; nothing for no blobs."""
    found: dict[str, list[np.ndarray]] = {}
    tool = zstandard.ZstdDecompressor()
    for blob in blobs:
        data = tool.decompress(blob)
        at = data.index(b"\0") + 1
        kinds = [(name, np.dtype(kind), int(width)) for name, kind, width in (x.split(":") for x in data[: at - 1].decode("ascii").split(","))]
        n = (len(data) - at) // sum(kind.itemsize * max(1, width) for _, kind, width in kinds)
        for name, kind, width in kinds:
            column = np.frombuffer(data, kind, n * max(1, width), at)
            at += column.nbytes
            found.setdefault(name, []).append(column.reshape(n, width) if width else column)
    return {name: np.concatenate(parts) for name, parts in found.items()}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def blob_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])


def by_part(part: np.ndarray, **columns: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for i, j in zip([0, *cuts] if len(part) else [], [*cuts, len(part)], strict=False):
        rows = order[i:j]
        yield int(part[i]), {k: c[rows] for k, c in columns.items()}


def first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the first row with its key, and how many rows have it."""
    order = np.argsort(keys, kind="stable")
    own, new = keys[order], np.ones(len(keys), bool)
    new[1:] = own[1:] != own[:-1]
    group = np.cumsum(new) - 1
    first, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    first[order] = order[new][group]
    count[order] = np.bincount(group)[group]
    return first, count


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [(x.as_py() or "").encode("utf-8") for x in column]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(24)) % np.uint64(n)).astype(np.int64)


def passed(rows: pa.Table, part: int) -> pa.Table:
    """Rows that are for a part of documents already."""
    return pa.table({"part": pa.array(np.full(len(rows), part), pa.int32()), "kind": rows.column("kind"), "data": rows.column("data")})


def dealt_keys(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, home: np.ndarray, n_parts: int) -> list[tuple[int, int, bytes]]:
    """Rows for settled_keys: one of each key by its bucket, with how many there are here; the others are repeated for sure and go to their own part."""
    first, count = first_of(h)
    own = first == np.arange(len(h))
    rows = [(n_parts + p, REPEAT, pack(**c)) for p, c in by_part(home[~own], doc=doc[~own], pos=pos[~own])]
    return rows + [(b, REPEAT, pack(**c)) for b, c in by_part(bucket_of(h[own], n_parts), h=h[own], doc=doc[own], pos=pos[own], count=count[own], home=home[own])]


def settled_keys(own: dict[str, np.ndarray], hot: int) -> tuple[list[tuple[int, int, bytes]], np.ndarray]:
    """Of a bucket: rows of the places whose key occurs again, by their own part, and of keys over hot with their counts; which keys occur again."""
    h = own["h"]
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    total = np.add.reduceat(own["count"][order], np.flatnonzero(new))
    many = np.empty(len(h), np.int64)
    many[order] = total[np.cumsum(new) - 1]
    again = many > 1
    out = [(p, REPEAT, pack(**c)) for p, c in by_part(own["home"][again], doc=own["doc"][again], pos=own["pos"][again])]
    frequent, at = np.unique(h[many > hot], return_index=True)
    if len(frequent):
        out.append((-1, FREQUENT, pack(h=frequent, count=many[many > hot][at])))
    return out, h[again]
