import hashlib
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from tesserae.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Codec(PATH), Tokenizer.from_file(PATH)


def same(both, text):
    own, library = both
    want = library.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    assert got == want, text[:80]
    assert own.decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " \n\t", "Ein Haus's'll don't", "<|endoftext|>a<|startoftext|> <|", "ΣΑΣ İıŉ ſ", "é ẛ̣", "日本語 😀🏽", "½²³ 12a", "\x1c\x85\xa0x", "a" * 5000, "A" * 513, "!?" * 400])
def test_edge_texts(both, text):
    same(both, text)


def test_random_texts(both):
    rng = random.Random(1)
    kinds = ["abcdefgh", "etaoinsh", "aab", "!?.-_'", "çéñüßÉ", "日本Ωσς", "́̈", "123½²", "  \n", "😀", "<|>"]
    for _ in range(1500):
        same(both, "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60))))


def test_long_unsplit_texts_are_trees(both):
    rng = random.Random(2)
    parts = ["the", "ing", "tion", "ble", "er", "a", "ch", "é", "ß"]
    for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 2 * bpe.LEAF + 1, 3000):
        same(both, "".join(rng.choice(parts) for _ in range(n)))
        same(both, "".join(rng.choice("ab") for _ in range(n)))


def test_small_leaves_join_exactly(both, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 4)
    monkeypatch.setattr(bpe, "LEAF", 3)
    rng = random.Random(3)
    own = bpe.Codec(PATH)
    for _ in range(300):
        same((own, both[1]), "".join(rng.choice("thersion") for _ in range(rng.randint(1, 40))))


def test_a_full_store_of_pieces_is_emptied(both, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    same((bpe.Codec(PATH), both[1]), "one two three four five six one two")


def test_special_tokens_of_other_kinds(tmp_path):
    """One that begins as none of the file's own does."""
    spec = json.loads(Path(PATH).read_text())
    spec["added_tokens"].append({**spec["added_tokens"][-1], "content": "[TURN]", "id": max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1})
    path = tmp_path / "own.json"
    path.write_text(json.dumps(spec))
    own, library = bpe.Codec(str(path)), Tokenizer.from_file(str(path))
    for text in ("one [TURN] two", "[TURN][TURN]x", "a [TUR] b"):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_frames(spark, both):
    rows = [(1, "Some text", "x"), (1, "Some text", "y"), (2, None, "z"), (None, "", None), (3, "word " * 2000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    coded = bpe.encode(docs, PATH)
    found = bpe.decode(coded, PATH).collect()
    assert len(found) == 5
    for r in found:
        if r["doc_id"] in (None, 2):
            assert r["n_tokens"] == 0 and r["decoded"] == ""
    first = next(r for r in found if r["doc_id"] == 1)
    want = both[1].encode("Some text", add_special_tokens=False).ids
    assert bytes(first["token_bytes"]) == np.array(want, "<u4").tobytes() and first["n_tokens"] == len(want)
    assert bpe.decode(bpe.encode(docs.where("false"), PATH), PATH).count() == 0


def test_query_digests(spark, sf_dir, both):
    found = {r["doc_id"]: r for r in bpe.op3_bpe(spark, sf_dir).collect()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(found) == len(texts)
    for r in texts:
        ids = both[1].encode(r["text"], add_special_tokens=False).ids
        decoded = both[1].decode(ids, skip_special_tokens=False)
        got = found[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
