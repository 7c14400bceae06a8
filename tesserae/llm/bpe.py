"""BPE encoding and decoding with a public vocabulary.

A text is cut at special tokens, normalized, and split into pieces; a piece is encoded on its own, so its ids are kept
per piece and a text is a gather of them. A piece longer than LONG symbols is encoded by tree concatenation: leaves are
encoded apart, and at each join a window around it grows until its encoding starts with the left side's token and ends
with the right side's. A sequence of tokens is the encoding of its text if each two neighbours are that of theirs, which
the left side, the window and the right side each vouch for, so the result is that of the whole piece.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbols above which a piece is encoded as a tree, and symbols of a leaf.
LONG, LEAF = 512, 128
#: Pieces whose ids a worker keeps, and symbols of the longest one that is kept.
KEPT, KEPT_SYMBOLS = 200_000, 64
#: Texts of an output batch have about so many bytes.
OUT_BYTES = 4 << 20
#: Text in which Python and the tokenizers library agree on case, white space and letters; other text takes the library's own normalizer.
PLAIN = r"[^\t\n\r\x20-\x7e¡-įĲ-ňŊ-ž]"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: its own, or the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Codec:
    """Encodes and decodes as the tokenizer of one file does, without special tokens of its own adding."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.outer = self.tokenizer.model
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        #: The same merges for text that doesn't end its piece.
        self.inner = BPE(vocab=spec["model"]["vocab"], merges=merges)
        #: Encodes leaves on as many threads as the library has; what it gets is one piece each.
        self.leaves = Tokenizer(self.inner)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.odd = regex.compile(PLAIN)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")
        self.begin = os.path.commonprefix(list(self.special))
        self.symbol = byte_symbols()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token = [""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            self.token[i] = text
        self.known: dict[str, tuple[int, ...]] = {}

    def ids(self, mapped: str, ends: bool) -> list[int]:
        """Ids of byte symbols; ends: they end their piece."""
        return [t.id for t in (self.outer if ends else self.inner).tokenize(mapped)] if mapped else []

    def text_of(self, ids: list[int]) -> str:
        """The byte symbols that ids stand for."""
        return "".join(self.token[i].removesuffix(self.suffix) if self.suffix else self.token[i] for i in ids)

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """The encoding of what left and right stand for together."""
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            own, other = left[len(left) - a :], right[:b]
            found = self.ids(self.text_of(own) + self.text_of(other), ends and b == len(right))
            fits_left = a == len(left) or found[0] == own[0]
            fits_right = b == len(right) or found[-1] == other[-1]
            if fits_left and fits_right:
                return left[: len(left) - a] + found + right[b:]
            a, b = a if fits_left else 2 * a, b if fits_right else 2 * b

    def tree(self, mapped: str) -> list[int]:
        """Ids of one long piece: leaves side by side, then joins of neighbours level by level."""
        parts = [mapped[i : i + LEAF] for i in range(0, len(mapped), LEAF)]
        level = [e.ids for e in self.leaves.encode_batch(parts[:-1], add_special_tokens=False)] + [self.ids(parts[-1], True)]
        while len(level) > 1:
            last = len(level) - 1
            level = [self.join(level[i], level[i + 1], i + 1 == last) if i < last else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def piece(self, mapped: str) -> tuple[int, ...]:
        return tuple(self.tree(mapped) if len(mapped) > LONG else self.ids(mapped, True))

    def plain(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece as text, kept for the next time."""
        symbol = self.symbol
        found = self.piece("".join([symbol[b] for b in piece.encode("utf-8")]))
        if len(piece) <= KEPT_SYMBOLS:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[piece] = found
        return found

    def part(self, text: str, out: list[int]) -> None:
        """Appends the ids of text without special tokens."""
        if self.odd.search(text) is None:
            known = self.known
            for piece in self.split.findall(text.lower()):
                out += known.get(piece) or self.plain(piece)
            return
        normal = self.tokenizer.normalizer.normalize_str(text)
        for mapped, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
            out += self.piece(mapped)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for null."""
        out: list[int] = []
        if not text:
            return out
        if not self.special or self.begin not in text:
            self.part(text, out)
            return out
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                self.part(part, out)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens with a space between, as the library does for a file without a decoder. Ids beyond the vocabulary are left out."""
        token, top = self.token, len(self.token)
        if ids and max(ids) >= top:
            ids = [i for i in ids if i < top]
        return " ".join(map(token.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """A worker reads a vocabulary once."""
    return Codec(path)


def _batches(rows: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, int]]:
    """Cuts a batch where about `most` bytes of its column have passed."""
    begin, size = 0, 0
    for i in range(rows.num_rows):
        x = rows.column(column)[i]
        size += 64 + (len(x.as_buffer()) if x.is_valid else 0)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < rows.num_rows:
        yield begin, rows.num_rows


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs, in any order: the id, n_tokens, and token_bytes, the ids as little-endian unsigned 32-bit integers.

    A null or empty text has no tokens; rows of a repeated id stay apart. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for i, j in _batches(batch, 1, OUT_BYTES):
                rows = [tool.encode(t) for t in batch.column(1)[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([len(r) for r in rows], pa.int64()), pa.array([np.array(r, "<u4").tobytes() for r in rows], pa.binary())], ["id", "n_tokens", "token_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, n_tokens long, token_bytes binary").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of encode with the text that their ids decode to; null bytes decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            for i, j in _batches(batch, 2, OUT_BYTES):
                texts = [tool.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(2)[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns), pa.array(texts, pa.string())], ["id", "n_tokens", "token_bytes", "decoded"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("id"), "n_tokens", "token_bytes").mapInArrow(run, f"id {kind}, n_tokens long, token_bytes binary, decoded string").withColumnRenamed("id", id_col)


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of ids and decoded text; path is the vocabulary's file, which every executor must have."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = decode(encode(docs, path), path)
    return both.select("doc_id", "n_tokens", F.sha2("token_bytes", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op3_bpe": op3_bpe}
