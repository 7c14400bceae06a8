import random
import re
from collections import defaultdict

import pytest

from tesserae.llm import minhash


def shingles(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs):
    """doc_id, set size and smallest id reachable, from all pairs that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in where[x]:
                shared[j] += 1
            where[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), d if not s else least[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def found(spark, docs):
    rows = minhash.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def edited(seed, groups, copies, edits):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [rng.choices(words, k=rng.randint(1, 150)) for _ in range(groups)]
    docs = []
    for i in range(copies):
        own = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append((i, " ".join(own)))
    return docs


EDGES = [(1000, None), (1001, ""), (1002, " \n\t\x0b\x0c\r"), (1003, "a"), (1004, "A"), (1005, "a b c"), (1006, "x " * 5000), (1007, "nb sp word"), (1008, "É é"), (1009, "é é")]


def test_equals_all_pairs(spark):
    docs = edited(5, 30, 300, 6) + EDGES
    assert found(spark, docs) == brute(docs)


def test_one_group_cut_into_blocks(spark, monkeypatch):
    """Keys over HOT and families over BLOCK take the paths of large groups."""
    monkeypatch.setattr(minhash, "HOT", 10)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    docs = edited(7, 3, 120, 5) + EDGES
    assert found(spark, docs) == brute(docs)


def test_a_key_of_many_classes_is_cut(spark, monkeypatch):
    """Keys over MEET go on as pairs of blocks, and give the same classes."""
    monkeypatch.setattr(minhash, "MEET", 6)
    monkeypatch.setattr(minhash, "HOT", 50)
    docs = edited(9, 3, 150, 5) + EDGES
    assert found(spark, docs) == brute(docs)


def test_blocks_of_unlike_members_are_bounded(spark):
    """100,000 classes of one key with unlike sketches, among which some are near: no task compares over MEET and some."""
    import numpy as np

    from tesserae.llm.blobs import blob_rows, pack
    from tesserae.llm.scratch import Scratch

    n = 100_000
    sketch = np.random.default_rng(1).integers(0, 256, (n, minhash.SKETCH), dtype=np.uint8)
    sketch[n - 1], sketch[n // 2] = sketch[0], sketch[1]
    row = blob_rows([(0, 0, pack(h=np.full(n, 1 << 63, np.uint64), cid=np.arange(n), sketch=sketch))]).to_pandas()
    rows = spark.createDataFrame([(0, 0, bytearray(row["data"][0]))], "part int, kind int, data binary")
    room, sizes = Scratch(spark, "met"), []

    class Spy:
        def keep(self, rows, name):
            kept = room.keep(rows, name)
            sizes.extend(len(minhash.unpack([bytes(r["data"])])["cid"]) for r in kept.where("data is not null").collect())
            return kept

    minhash.families(rows, Spy())
    assert sum(sizes) == n and max(sizes) < 0.6 * minhash.MEET


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_sets_of_long_texts_equal_those_of_short_ones(monkeypatch, piece):
    """A text over PIECE is hashed piece by piece; words and shingles across pieces are the same."""
    rng = random.Random(piece)
    texts = ["", " ", "a", "a b c d", "a b c d e", "  A b\tc d e  ", "x" * 300, "ab " * 90, " ".join("w" * rng.randint(1, 20) + str(rng.randint(0, 5)) for _ in range(80)), "é ñ " * 40]
    whole = [minhash.shingle_sets([t.encode()])[0].tolist() for t in texts]
    assert [len(w) for w in whole] == [len(shingles(t)) for t in texts]
    assert [s.tolist() for s in minhash.shingle_sets([t.encode() for t in texts])] == whole
    monkeypatch.setattr(minhash, "PIECE", piece)
    assert [minhash.long_set(t.encode()).tolist() for t in texts] == whole
    encoded = [t.encode() for t in texts]
    cut = list(minhash._portions(encoded))
    assert [i for i, _ in cut] == [0, *(j for _, j in cut[:-1])] and cut[-1][1] == len(texts)
    assert all(j - i == 1 for i, j in cut if any(len(t) > piece for t in encoded[i:j]))


@pytest.mark.parametrize("one_word", [True, False])
def test_memory_of_a_very_long_text(one_word):
    """20 MB of distinct words, or one word of 20 MB, take a few bytes for a byte beside the text."""
    import tracemalloc

    long = b"x" * 20_000_000 if one_word else b" ".join(b"word%d" % i for i in range(1_700_000))
    tracemalloc.start()
    minhash.minhashes(minhash.shingle_sets([long])[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = minhash.op6_minhash(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == brute(docs)


def test_repeated_and_null_ids_clashing_columns_and_no_rows(spark):
    rows = [(1, "one two three four five six", 0, "x"), (1, "other words stand here instead of them", 1, "x"), (None, "one two three four five six", 2, "x"), (2, "ONE two three four five six", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, component_id string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, docs).collect()), key=repr)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, True)]
    assert minhash.near_duplicates(spark, docs.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    from tesserae.llm.scratch import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    rows = minhash.components(edges, Scratch(spark, "test"), "chain").collect()
    assert sorted((r["id"], r["component"]) for r in rows) == [(i, 0) for i in range(61)] + [(100, 100), (101, 100)]


@pytest.mark.parametrize("n", [2, 3, 40])
def test_links_at_the_limit(n):
    import numpy as np

    # 75 of 100 shared links, 74 of 100 doesn't.
    base = np.arange(1000, 1087, dtype=np.uint64)
    near = np.concatenate([base[:75], np.arange(1, 14, dtype=np.uint64)])
    far = np.concatenate([base[:74], np.arange(20, 33, dtype=np.uint64)])
    more = [np.arange(5000 + 100 * i, 5050 + 100 * i, dtype=np.uint64) for i in range(n - 2)]
    assert len(minhash.linked([np.sort(base), np.sort(near), *more])) == 1
    assert len(minhash.linked([np.sort(base), np.sort(far), *more])) == 0
