"""Removal of windows against all windows as tuples of words."""

import random
import re

import numpy as np
import pytest

from tesserae.llm import windows

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(docs, n):
    """docs: (doc_id, text); rows of one id don't count for each other, null is last."""
    words = [WORD.findall(t or "") for _, t in docs]
    rank = [float("inf") if i is None else i for i, _ in docs]
    least = {}
    for r, w in zip(rank, words):
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            least[key] = min(least.get(key, r), r)
    out = []
    for (doc_id, _), r, w in zip(docs, rank, words):
        gone = {i + k for i in range(len(w) - n + 1) if least[tuple(w[i : i + n])] < r for k in range(n)}
        out.append((doc_id, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return sorted(out, key=repr)


def made(seed, count=60):
    rng = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(rng.randrange(3, 70))] for k in range(12)]
    docs = []
    for i in range(count):
        parts = [rng.choice(passages) if rng.random() < 0.6 else [rng.choice("abcdé") for _ in range(rng.randrange(30))] for _ in range(rng.randrange(6))]
        words = [w for p in parts for w in p]
        docs.append((i, "".join(w + rng.choice([" ", "\n", " \t", "\x0b", "\r\n"]) for w in words)))
    hot = " ".join(f"h{i}" for i in range(80))
    docs += [(1000 + i, rng.choice(["", "x ", "  "]) + hot) for i in range(25)] + [(2000, None), (2001, ""), (2002, "\x1c \x85 é "), (2003, " ".join("ab"[i % 2] for i in range(400)))]
    docs += [(1, hot), (1, hot), (None, hot), (None, docs[3][1]), (3, docs[3][1]), (None, None)]
    return docs


def got(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as doc", "3 as spans", "4 as cut")
    found = windows.remove_repeated_windows(spark, df)
    assert found.columns == ["doc_id", "kept_1", "n_words", "n_removed", "kept", "doc", "spans", "cut"]
    return sorted(map(tuple, found.select("doc_id", "kept_1", "n_words", "n_removed").collect()), key=repr)


@pytest.mark.parametrize("unique", [True, False])
def test_against_all_windows(spark, unique, monkeypatch):
    monkeypatch.setattr(windows, "LEAST_BYTES", 3000)
    monkeypatch.setattr(windows, "SHARE", 1)
    docs = made(11)
    if unique:
        docs = list({i: (i, t) for i, t in docs if i is not None}.values())
    found = got(spark, docs)
    assert found == plain(docs, windows.WORDS)
    assert sum(r[3] for r in found) > 1000


def test_empty_tables(spark):
    assert got(spark, []) == [] and got(spark, [(None, None), (1, "a")]) == [(1, "a", 1, 0), (None, "", 0, 0)]


def test_a_sketch_never_counts_too_little():
    rng = np.random.default_rng(4)
    groups = [rng.integers(0, 3000, n).astype(np.uint64) for n in (500, 1500, 10)]
    total = np.zeros((5, 2, 256), int)
    truth = {}
    for g in groups:
        own, count = np.unique(g, return_counts=True)
        for h, c in zip(own.tolist(), count.tolist()):
            truth[h] = truth.get(h, 0) + min(c, 2)
        for segment, row, cells, twice, _, _ in windows.sketch(windows.mixed(own), count > 1, 5, 256):
            assert (windows._cells(windows._planes(cells)) == cells).all() and len(np.unique(cells)) == len(cells)
            total[segment, row, cells] += 1 + twice
    for h, c in truth.items():
        key = windows.mixed(np.array([h], np.uint64))
        s = int(windows.bucket_of(key, 5)[0])
        estimate = min(total[s, row, windows.cells_of(key, row, 256)[0]] for row in range(windows.ROWS_OF_SKETCH))
        assert c < 2 or estimate >= 2


def test_few_single_windows_are_estimated_as_repeated():
    own = windows.mixed(np.arange(40_000, dtype=np.uint64))
    wrong = np.ones(len(own), bool)
    for _, _, _, twice, number, inverse in windows.sketch(own, np.zeros(len(own), bool), 1, 1 << 18):
        wrong[number] &= twice[inverse]
    assert wrong.mean() < 0.04


def test_long_texts_in_portions(monkeypatch):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(3000)).encode()
    spans = [(5, 60), (100, 101), (700, 2900)]
    want, whole = windows.cut_words(text, spans), windows.Windows([text, b"a", text])
    assert want[1:] == (3000, 55 + 1 + 2200)
    monkeypatch.setattr("tesserae.llm.audit.PORTION", 64)
    monkeypatch.setattr(windows, "STEP", 128)
    cut = windows.Windows([text, b"a", text])
    assert windows.cut_words(text, spans) == want
    assert all((getattr(cut, n) == getattr(whole, n)).all() for n in ("hashes", "doc", "pos"))
    words = text.split()
    assert len({tuple(words[i : i + 50]) for i in range(2951)}) == len(np.unique(whole.hashes, axis=0))
