"""WARC archives: a writer with revisit records and a sequential reader.

Each record is a gzip member of its own, so a reader can stop or start at any record. The reader decompresses
incrementally, frames the block by its Content-Length and verifies both digests, never holding more than one record.
Archives are real files under the shared folder; a writer task names its files by a fresh id and reports them in a
manifest, so what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.scratch import Scratch

#: Fixed values of the format.
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.0", b"WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

#: Bytes read or inflated at once, and most bytes of a record's head.
CHUNK, HEAD = 1 << 16, 1 << 20
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(data: bytes) -> str:
    """SHA-1 as bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP headers and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c for c in url if c >= " ")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + END


def member(data: bytes, level: int = 6) -> bytes:
    """data as one gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def inflated(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The contents of each gzip member in turn, each inflated CHUNK at a time as it is asked for."""
    rest = b""

    def one() -> Iterator[bytes]:
        nonlocal rest
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            rest = rest or stream.read(CHUNK)
            if not rest:
                raise ValueError("the archive ends inside a record")
            data = unpacker.decompress(rest, CHUNK)
            rest = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
            if data:
                yield data

    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        chunks = one()
        yield chunks
        for _ in chunks:  # what a reader left of it
            pass


def framed(chunks: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record that a member holds. Content-Length bounds what is inflated: a member with more
    or less than its head, its block and the end is a ValueError, and so are a head of over HEAD bytes and one without a length."""
    data = bytearray()
    at = -1
    for chunk in chunks:
        data += chunk
        at = data.find(END, max(0, len(data) - len(chunk) - 3))
        if at >= 0 or len(data) > HEAD:
            break
    first, _, lines = bytes(data[: max(at, 0)]).partition(b"\r\n")
    if at < 0 or first not in VERSIONS:
        raise ValueError(f"not a WARC record: {bytes(data[:40])!r}")
    fields = _fields(lines)
    said = fields.get("content-length", "")
    if not (said.isascii() and said.isdigit()):
        raise ValueError(f"a record needs a Content-Length, not {said!r}")
    del data[: at + len(END)]
    size = int(said)
    while len(data) <= size + len(END):
        chunk = next(chunks, None)
        if chunk is None:
            break
        data += chunk
    if len(data) != size + len(END) or data[size:] != END:
        raise ValueError("the block is not as long as its Content-Length")
    return fields, bytes(data[:size])


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.removeprefix("-").isdecimal() else None


def understood(fields: dict[str, str], block: bytes) -> dict[str, Any]:
    """One record's result. ValueError where a digest that it gives is wrong.

    The payload of a response is what follows its HTTP head, with any transfer coding as it is stored; that of a revisit is
    left out, and its size is the one that the HTTP head gives, if any. Records of other kinds (warcinfo, request, metadata and so
    on) have their whole block as payload. A record whose id is not one of this writer has no page_id."""
    kind = fields.get("warc-type", "")
    said = fields.get("warc-block-digest")
    if said is not None and said.startswith("sha1:") and said != f"sha1:{digest(block)}":
        raise ValueError("the block digest is wrong")
    payload, size, coded = block, len(block), False
    if kind in ("response", "revisit"):
        http, found, payload = block.partition(END)
        inner = _fields(http.partition(b"\r\n")[2])
        told, coded = inner.get("content-length", ""), "transfer-encoding" in inner
        if kind == "revisit":
            size = int(told) if told.isdecimal() else None
        else:
            size = len(payload)
            if told.isdecimal() and not coded and int(told) != size:
                raise ValueError("the payload is not as long as its HTTP head says")
    said = fields.get("warc-payload-digest", "")
    if kind == "response" and not coded and said.startswith("sha1:") and said != f"sha1:{digest(payload)}":
        raise ValueError("the payload digest is wrong")
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "payload": None if kind == "revisit" else payload,
        "payload_bytes": size,
        "payload_digest": said.removeprefix("sha1:") or (None if kind == "revisit" else digest(payload)),
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")) if kind == "revisit" else None,
    }


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The whole contents of each gzip member in turn."""
    for chunks in inflated(stream):
        yield b"".join(chunks)


def parse(data: bytes) -> dict[str, Any]:
    """The result of one record that is in memory. ValueError where framing or a digest is wrong."""
    return understood(*framed(iter([data])))


def _open(path: str, how: str) -> Any:
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    if how == "r":
        return files.open_input_stream(at, compression=None)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    return files.open_output_stream(at, compression=None)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, html digest and response's page_id of each row whose payload a row with a larger page_id repeats. A row without
    a page_id revisits any row that has one; where none has, all are responses.

    Only ids and digests are shuffled, and a digest's rows meet pre-aggregated: one very common payload is a row per task.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= min_bytes)
    last = keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(last, "digest").where("refers_to is not null and (page_id is null or page_id < refers_to)").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, max_archive_bytes: int = 1 << 27, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) into archives under folder; returns their manifest, to be
    written before it is used. A null html is an empty payload and a null page_id a record without a number, which is a
    revisit if a row with a number has its payload, else a response; rows of the same page_id and html are all response. Columns other than these three are not looked at."""
    pages = pages.select("page_id", "url", "html")
    seen = revisits(pages, min_bytes).select(F.col("page_id").alias("seen_id"), F.col("digest").alias("seen_digest"), "refers_to")
    own = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    rows = pages.withColumn("digest", own).join(seen, F.col("page_id").eqNullSafe(F.col("seen_id")) & (F.col("digest") == F.col("seen_digest")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int, int]] = []
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, "w")
                page_id, url, html, refers, hit = (batch.column(c)[i].as_py() for c in range(5))
                packed = member(record(page_id, url, (html or "").encode("utf-8"), refers, hit is not None, date))
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= max_archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        paths, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return rows.select("page_id", "url", "html", "refers_to", "seen_digest").mapInArrow(write, MANIFEST)


def read_archives(paths: DataFrame, with_payload: bool = True, batch_bytes: int = 1 << 23) -> DataFrame:
    """The records of the archives named in column path, each archive read from its start to its end by one task. Archives of
    other writers are read too, if each record is a gzip member."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def packed(rows: list[dict[str, Any]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path, "r") as stream:
                    for chunks in inflated(stream):
                        found = understood(*framed(chunks))
                        if not with_payload:
                            found["payload"] = None
                        rows.append(found)
                        size += 200 + len(found["payload"] or b"")
                        if size >= batch_bytes:
                            yield packed(rows)
                            rows, size = [], 0
        yield packed(rows)

    return paths.select("path").mapInArrow(read, RECORDS)


def warc_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, with_payload: bool = True) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back. An empty table gives no rows."""
    room = Scratch(spark, "warc")
    manifest = room.keep(write_archives(pages, f"{room.path}/archives", min_bytes), "manifest")
    n = manifest.count()
    return read_archives(manifest.repartition(max(1, n)), with_payload)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc_round_trip(spark, pages, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc": op10_warc}

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: DuckDB has no base32: 40 hex digits are 160 bits, and each 5 bits are a letter.
ORACLES = {
    "op10_warc": f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
l as (select h, max(page_id) as top from p group by h),
b as (select h, string_agg(substr('{_B32}', 1 + bits, 1), '' order by j) as d
      from (select h, j, cast(list_sum([((instr('0123456789abcdef', substr(h, 1 + k // 4, 1)) - 1) >> (3 - k % 4)) % 2 * (1 << (4 - (k - 5 * j))) for k in range(5 * j, 5 * j + 5)]) as int) as bits
            from (select h, unnest(range(32)) as j from l)) group by h)
select p.page_id, cast(strlen(p.html) as bigint) as payload_bytes, b.d as payload_digest,
       case when p.page_id < l.top then 'revisit' else 'response' end as record_type,
       case when p.page_id < l.top then l.top end as refers_to
from p join l using (h) join b using (h)"""
}
