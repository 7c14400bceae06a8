import random

import numpy as np
import pytest

from tesserae.llm import suffixes


def brute(docs, length=suffixes.LENGTH):
    """Spans of each document by a set of all strings before, in order of id."""
    seen, out = set(), {}
    for name, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(part)
        edges = np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), np.uint8), [0]]).astype(int))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
        out[name] = (bytes(c for c, g in zip(data, gone, strict=True) if not g), spans)
    return out


def found(spark, docs):
    rows = suffixes.remove_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return {r["doc_id"]: (bytes(r["kept"]), [(s["start"], s["end"]) for s in r["removed"]]) for r in rows}


def patched(seed):
    rng = random.Random(seed)
    units = ["ab", "cde", "the", "fé", "日本", "zz "]
    bases = ["".join(rng.choice(units) for _ in range(200)) for _ in range(6)]

    def cut():
        base = rng.choice(bases)
        at = rng.randint(0, 200)
        return base[at : at + rng.randint(20, 300)]

    docs = [(i, "".join(cut() for _ in range(rng.randint(0, 6)))) for i in range(80)]
    return docs + [(1000, None), (1001, ""), (1002, "a" * 3000), (1003, "a" * 99), (1004, "ab" * 1000), (1005, "a" * 300 + "b" * 300), (1006, "\0" * 250 + "a" * 120)]


@pytest.mark.parametrize("hot", [suffixes.HOT, 5])
def test_equals_a_set_of_all_strings(spark, monkeypatch, hot):
    """A small HOT takes the path of strings that occur very often."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    docs = patched(3)
    assert found(spark, docs) == brute(docs)


def test_many_parts_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "LEAST_BYTES", 3000)
    monkeypatch.setattr(suffixes, "SHARE", 1)
    monkeypatch.setattr(suffixes, "SAMPLED", 2)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    docs = patched(4)
    assert found(spark, docs) == brute(docs)


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(docs)
    for r in suffixes.op8_suffixes(spark, sf_dir).collect():
        kept, spans = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(kept) + sum(b - a for a, b in spans), sum(b - a for a, b in spans), len(spans))


def test_repeated_and_null_ids_clashing_columns_and_no_rows(spark):
    text = "x" * 50 + "the quick brown fox jumps over the lazy dog and then some more words follow " * 2
    rows = [(1, text, 7, "a"), (1, text, 8, "b"), (1, "other " + text, 9, "c"), (2, None, 1, "d"), (None, text, 2, "e"), (3, text + "zz", 4, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, kept string").withColumnRenamed("kept", "rest")
    got = {r["part"]: (r["doc_id"], len(r["kept"]), r["rest"]) for r in suffixes.remove_repeats(spark, docs).collect()}
    assert len(got) == 6 and got[1] == (2, 0, "d") and got[2] == (None, 0, "e") and got[4] == (3, 2, "f")
    # Of the two documents with id 1 the one with the smaller digest is the first; equal rows have the same result.
    assert got[7][1] == got[8][1] and {got[7][1], got[9][1]} in ({len(text), 6}, {0, len(text) + 6})
    assert suffixes.remove_repeats(spark, docs.where("false")).count() == 0


def test_multikey_sort():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, size=(500, 4)).astype(np.uint64)
    order = suffixes.multikey_sort(words)
    assert (words[order] == words[np.lexsort(words.T[::-1])]).all() and sorted(order) == list(range(500))


def test_anchors_depend_on_their_string_only():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    where = set(suffixes.anchors(text, [(0, 400)])[0].tolist())
    for i in range(0, 301, 7):
        own, _ = suffixes.anchors(text[i : i + suffixes.LENGTH], [(0, suffixes.LENGTH)])
        assert len(own) == 1 and i + int(own[0]) in where


@pytest.mark.parametrize("kind", ["start", "string"])
def test_splitters_cut_common_starts(kind):
    """Where 90 % of a sample have one start of 16 bytes, or are one string, the others are spread evenly all the same."""
    rng, n = np.random.default_rng(4), 64
    leads = rng.integers(97, 123, (10_000, suffixes.LEAD), dtype=np.uint8)
    leads[:9_000, : 16 if kind == "start" else suffixes.LEAD] = ord("-")
    cuts = suffixes.splitters(leads, n)
    rest = leads if kind == "start" else leads[9_000:]
    share = np.bincount(np.searchsorted(cuts, suffixes._strings(rest), side="right"), minlength=n) / len(rest)
    assert len(cuts) >= 0.9 * (n - 1) and share.max() < 0.05
    assert len(suffixes.splitters(leads[:0], n)) == 0 and len(suffixes.splitters(leads[:1], 1)) == 0
