"""Columns that clash with own names, nest, or can't be null come back unchanged from stages and operators."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tesserae.llm import lines, minhash, mtree, neighbours, packing, suffixes, toxicity, warc
from tesserae.llm.columns import free, named

NAMES = ["toxicity", "removed", "kept", "lost", "kept_id", "digest", "class", "rank", "score", "rest", "doc", "spans", "cut", "id", "own", "text_1", "__id", "__own", "print", "node", "with`tick", "a.b", "_place", "Removed_1"]


def dressed(spark, n=12):
    """Documents with odd further columns: their ids are in part null and repeated."""
    same = "\n".join(f"line {k} that many documents have, with some more words of it so that it is long" for k in range(5))
    rows = [(i % 9 if i % 5 else None, same if i % 3 == 0 else f"text {i} " * (i + 1), "en", None if i % 4 == 0 else f"s{i % 2}", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("row", F.col("n_chars")).withColumn("fixed", F.lit(7)).withColumn("many", F.array(F.lit(1), F.col("n_chars").cast("int"))).withColumn("map", F.create_map(F.lit("a"), F.col("n_chars")))
    docs = docs.withColumn("nested", F.struct(F.lit(1).alias("x"), F.array(F.struct(F.col("n_chars").alias("y"))).alias("z"))).withColumn("when", F.timestamp_seconds(F.col("n_chars")))
    return docs.select("*", *(F.concat(F.lit(f"{name}-"), F.col("n_chars").cast("string")).alias(name) for name in NAMES))


def others(rows, columns):
    return {r["row"]: tuple(repr(r[c]) for c in columns) for r in rows}


@pytest.mark.parametrize("stage", ["toxicity", "line_dedup", "near_dedup", "suffix_dedup"])
def test_stages_keep_odd_columns(spark, sf_dir, stage):
    docs = dressed(spark)
    found = getattr(corpus_pipeline, stage)(spark, docs, sf_dir)
    assert found.columns == docs.columns
    same = [c for c in docs.columns if c not in ("text", "n_chars")]
    before, rows = others(docs.collect(), same), found.collect()
    assert len({r["row"] for r in rows}) == len(rows) > 0
    assert all(before[k] == v for k, v in others(rows, same).items())


def test_operators_keep_odd_columns(spark):
    docs = dressed(spark)
    same = [c for c in docs.columns if c not in ("text", "kept", "removed", "toxicity")]
    before = others(docs.collect(), same)
    model = toxicity.Model({}, None, toxicity.np.zeros(1), toxicity.np.zeros(1))
    for found, new in ((toxicity.score(docs, model), "toxicity_1"), (lines.remove_repeated_lines(spark, docs), "removed_2"), (suffixes.remove_repeats(spark, docs), "kept_1")):
        assert new in found.columns
        rows = found.select("*").collect()
        assert others(rows, same) == before
        assert all(r[c] == f"{c}-{r['row']}" for r in rows for c in ("kept", "removed", "toxicity"))
    assert minhash.near_duplicates(spark, docs).count() == 12
    assert packing.pack_documents(docs).select("doc_id").count() >= 12
    assert packing.pack_documents(docs, cluster="source").count() >= 12
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *map(named, NAMES))
    assert warc.warc_round_trip(spark, pages).count() == 12
    vectors = docs.select(F.col("row").alias("vec_id"), F.array(F.col("row").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), *map(named, NAMES))
    assert neighbours.nearest(spark, vectors, F.col("vec_id") < 3).count() == 15
    assert mtree.largest_products(vectors, F.col("vec_id") < 3).count() == 15


def test_free_names():
    assert free(["a", "B"], "b") == "b_1" and free(["b", "B_1"], "b") == "b_2" and free([], "x") == "x"


def test_packing_orders_null_and_named_clusters(spark):
    rows = [(1, "a b", "s", None), (1, "a b", "s", "c"), (1, "a b", None, "c"), (None, "a b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster string")
    assert packing.pack_documents(docs, cluster="cluster").count() == 4


def test_minhash_links_through_rows_without_an_id(spark):
    """1 and 2 share too little, but both are linked to a text without an id."""
    words = [f"w{i}" for i in range(100)]
    left, middle, right = words[:], words[:], words[:]
    left[:8], right[-8:] = [f"l{i}" for i in range(8)], [f"r{i}" for i in range(8)]
    texts = [(1, left), (None, middle), (None, middle), (2, right), (None, [f"z{i}" for i in range(30)]), (7, [f"q{i}" for i in range(30)])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, docs).collect()), key=repr)
    assert got == sorted([(1, 1, True), (0, 1, True), (0, 1, True), (2, 1, False), (0, None, True), (7, 7, True)], key=repr)
    assert minhash.near_duplicates(spark, docs.where("doc_id is not null")).where("component_id = doc_id").count() == 3
