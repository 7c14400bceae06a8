import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import mtree, neighbours

ASKS = "vec_id % 50 = 0"


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, score int, class string")


def answers(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def brute(ids, scores, q, k=5):
    return [(int(ids[j]), scores[j]) for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]


def vectors(n, copies=0, seed=0, width=24):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, width))
    x = (centers[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, width))).astype(np.float32)
    if copies:
        x[rng.permutation(n)[:copies]] = x[0]
    return x


ODD = [(90001, None, 0, ""), (90002, [], 0, ""), (90003, [float("nan")] * 24, 0, ""), (90004, [float("inf")] + [0.0] * 23, 0, ""), (None, [1.0] * 24, 0, ""), (90006, [None] + [1.0] * 23, 0, ""), (90007, [1.0, 2.0], 0, "")]


@pytest.mark.parametrize("copies", [0, 500])
def test_products_equal_all_pairs(spark, copies, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 16)
    monkeypatch.setattr(mtree, "SHARD", 400)
    monkeypatch.setattr(mtree, "ASKED", 10)
    x = vectors(1500, copies)
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(x)]
    scaled = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    got = answers(mtree.largest_products(table(spark, rows + ODD), F.expr(ASKS)))
    assert set(got) == set(range(0, 1500, 50))
    for q in got:
        assert got[q] == [(i, int(s)) for i, s in brute(np.arange(1500), scaled @ scaled[q], q)]


def test_tree_spares_computations():
    rng = np.random.default_rng(2)
    centers = 4000 * rng.normal(size=(30, 8))
    x = np.floor(centers[rng.integers(0, 30, 6000)] + 20 * rng.normal(size=(6000, 8)))
    x = np.floor(x / np.linalg.norm(x, axis=1, keepdims=True) * 8000)
    tree = mtree.Tree(x, np.arange(6000), float((x**2).sum(axis=1).max()), 6)
    for q in range(0, 6000, 600):
        assert tree.search(x[q], q) == [(int(s), i) for i, s in brute(np.arange(6000), (x @ x[q]).astype(np.int64), q)]
    assert tree.computed < 0.5 * 10 * 6000


def test_products_too_large_are_an_error():
    with pytest.raises(ValueError):
        mtree.scaled([[1e300]])
    with pytest.raises(ValueError):
        mtree.products(np.array([[2.0**40]]), np.array([2.0**40]))


def test_products_that_fit_are_exact_however_large():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(40, 3)) * 10.0 ** rng.integers(0, 11, size=(40, 3)))
    x[0], x[1] = [2.0**70, 0, 5], [0, -(2.0**70), 5]
    for q in ([0.0, 0.0, 3.0], [0.0, 7.0, 2.0**31], [12345678901.0, -(2.0**30), 1.0]):
        want = [min(max(sum(int(a) * int(b) for a, b in zip(v, q)), mtree.TOO_SMALL), mtree.TOO_LARGE) for v in x.tolist()]
        assert mtree.products(x, np.array(q), strict=False).tolist() == want


def test_outliers_whose_scores_fit_are_no_error(spark):
    x = [[2e7, 0.0], [0.0, 2e7], *([float(i % 10) - 4, float(i // 10)] for i in range(2, 102)), [-1e30, 0.0]]
    rows = [(i, v, 0, "") for i, v in enumerate(x)]
    got = answers(mtree.largest_products(table(spark, rows, "double"), F.expr("vec_id in (0, 1, 58, 99)")))
    whole = [[int(np.floor(256 * c)) for c in v] for v in x]
    for q in (0, 1, 58, 99):
        scores = sorted(((sum(a * b for a, b in zip(v, whole[q])), -i) for i, v in enumerate(whole) if i != q), reverse=True)
        assert got[q] == [(-i, s) for s, i in scores[:5]]
    with pytest.raises(Exception, match="too large for 64 bits"):
        mtree.largest_products(table(spark, [*rows, (200, [2e7, 0.0], 0, "")], "double"), F.expr("vec_id = 0")).collect()


def test_pivots_of_a_whole_shard(spark):
    x = vectors(20000, 0, 5, 8)
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(x)]
    assert len(mtree.upper_level(table(spark, rows).withColumnRenamed("embedding", "vector"))[8].x) == 3
    got = answers(mtree.largest_products(table(spark, rows), F.expr("vec_id % 1000 = 0")))
    scaled = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 20000, 1000):
        assert got[q] == [(i, int(s)) for i, s in brute(np.arange(20000), scaled @ scaled[q], q)]


@pytest.mark.parametrize("copies", [0, 700])
def test_recall_and_scores(spark, copies):
    x = vectors(2000, copies, 1, 64)
    ids = np.arange(2000)
    rows = [(i, v.tolist(), 0, "") for i, v in enumerate(x)]
    got = answers(neighbours.nearest(spark, table(spark, rows + ODD), F.expr(ASKS)))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2000, 50):
        cosine = unit @ unit[q]
        assert len(got[q]) == 5
        for i, s in got[q]:
            assert s == pytest.approx(cosine[i], abs=1e-12) and i != q
        same = np.flatnonzero((x == x[q]).all(axis=1))
        if len(same) > 5:
            assert [i for i, _ in got[q]] == [int(i) for i in same if i != q][:5]
        hits += len({i for i, _ in got[q]} & {i for i, _ in brute(ids, np.round(cosine, 12), q)})
    assert hits / (5 * 40) >= 0.9


def test_recall_is_the_same_for_buckets_of_many_blocks(spark, monkeypatch):
    """Large tables: a small BUCKET, where there is one, made keys join another axis."""
    monkeypatch.setattr(neighbours, "BUCKET", 1, raising=False)
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    x = np.random.default_rng(6).normal(size=(2000, 64)).astype(np.float32)
    got = answers(neighbours.nearest(spark, table(spark, [(i, v.tolist(), 0, "") for i, v in enumerate(x)]), F.expr(ASKS)))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in brute(np.arange(2000), unit @ unit[q], q)}) for q in range(0, 2000, 50))
    assert hits / (5 * 40) >= 0.9


def test_fewer_rows_than_neighbours(spark):
    rows = [(0, [1.0, 0.0, 0.0], 0, ""), (1, [0.0, 1.0, 0.0], 0, ""), (2, [1.0, 1.0, 0.0], 0, ""), (3, [0.0] * 3, 0, ""), (50, [-1.0, 0.0, 0.0], 0, ""), (51, [2.0, 0.0, 0.0], 0, ""), (100, [1.0, 0.0], 0, "")]
    got = answers(neighbours.nearest(spark, table(spark, rows, "double"), F.expr(ASKS)))
    assert [i for i, _ in got[0]] == [51, 2, 1, 50] and [i for i, _ in got[50]] == [1, 2, 0, 51] and 100 not in got
    products = answers(mtree.largest_products(table(spark, rows, "double"), F.expr(ASKS)))
    assert products[50] == [(1, 0), (3, 0), (0, -65536), (2, -65536), (51, -131072)]
    empty = table(spark, rows, "double").where("false")
    assert neighbours.nearest(spark, empty, F.expr(ASKS)).count() == 0 and mtree.largest_products(empty, F.expr(ASKS)).count() == 0


def test_cosines_of_very_long_and_very_short_vectors():
    x = np.array([[1e300, 1e300], [1e-300, 0.0], [1.0, 0.0]])
    assert neighbours.cosines(x, x) == pytest.approx(np.array([[1, 0.5**0.5, 0.5**0.5], [0.5**0.5, 1, 1], [0.5**0.5, 1, 1]]))


def test_rotation_keeps_lengths_and_joined_keys_probe_the_own_one():
    x = np.random.default_rng(4).normal(size=(50, 20))
    assert np.linalg.norm(neighbours.rotations(x, 3), axis=1) == pytest.approx(np.linalg.norm(x, axis=1))
    own, probed = neighbours.probes(x, 0, 2, 1), neighbours.probes(x, 0, 2, 8)
    assert (own[:, 0] == probed[:, 0]).all() and all(len(set(p)) == 8 for p in probed.tolist())


def shares(x, queries):
    """The part of all vectors that queries reach in the tables of each level, and whether these hold their five nearest."""
    x = neighbours.unit(x.astype(np.float64))
    cosine = x[queries] @ x.T
    cosine[np.arange(len(queries)), queries] = -9
    top = np.argsort(-cosine, axis=1)[:, :5]
    out = []
    for tables, reach, least, _ in neighbours.LEVELS:
        hit = np.zeros(cosine.shape, bool)
        for t in range(tables):
            hit |= neighbours.reached(x[queries], neighbours.probes(x, t, neighbours.AXES, 1)[:, 0], t, reach, least)
        out.append((hit.mean(), np.take_along_axis(hit, top, axis=1).mean()))
    return out, np.take_along_axis(cosine, top[:, 4:], axis=1)


def test_few_vectors_are_looked_at_where_there_are_clusters():
    x = vectors(5000, 0, 3, 64)
    (near, _), fifth = shares(x, np.arange(0, 5000, 50))
    assert near[0] < 0.1 and near[1] > 0.97 and (fifth > neighbours.LEVELS[0][3]).mean() > 0.9


def test_share_without_contrast_and_by_width():
    """No more than a third is looked at where nothing is near, and the share is about the same for each width and number of vectors."""
    rng = np.random.default_rng(8)
    found = [shares(rng.normal(size=(n, width)), np.arange(0, n, n // 50))[0][1][0] for n, width in ((500, 64), (5000, 64), (2000, 16), (2000, 200))]
    assert max(found) < 1 / 3 and max(found) - min(found) < 0.15


def test_transform_of_each_width():
    for width in (1, 2, 8, 64, 128, 1024):
        x = np.random.default_rng(1).normal(size=(3, width))
        signs = 1.0 - 2.0 * (np.bitwise_count(np.arange(width)[:, None] & np.arange(width)) % 2)
        assert neighbours.hadamard(x) == pytest.approx(x @ signs / np.sqrt(width))


def test_many_scaled_copies_give_a_few_rows(spark):
    rows = [(i, [1.0 * (i + 1), 2.0 * (i + 1), 3.0 * (i + 1)], 0, "") for i in range(400)]
    got = answers(neighbours.nearest(spark, table(spark, rows, "double"), F.expr(ASKS)))
    assert all(len(v) == 5 for v in got.values())


def test_shards_are_pruned_where_there_are_clusters(spark, monkeypatch):
    """Few distances are computed, over shards of their own and within them; results are those of all pairs."""
    monkeypatch.setattr(mtree, "SHARD", 200)
    monkeypatch.setattr(mtree, "PAGE", 16)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 8))
    x = (centers[rng.integers(0, 30, 4000)] / np.linalg.norm(centers, axis=1).mean() + 0.01 * rng.normal(size=(4000, 8)))
    x = (8 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    counted = spark.sparkContext.accumulator(0)
    got = answers(mtree.largest_products(table(spark, [(i, v.tolist(), 0, "") for i, v in enumerate(x)]), F.expr(ASKS), counted))
    scaled = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    assert all(got[q] == [(i, int(s)) for i, s in brute(np.arange(4000), scaled @ scaled[q], q)] for q in range(0, 4000, 50))
    assert counted.value < 0.3 * 80 * 4000
