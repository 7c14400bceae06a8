import corpus_pipeline
import pytest


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        assert rows.columns == columns, name
        docs = spark.createDataFrame(rows.collect(), rows.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.packing(spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}


def test_odd_rows_and_no_rows(spark, sf_dir):
    text = "first line of a text that is long enough to count for something here\nsecond line of it\nthird line\nfourth"
    rows = [(1, text, "en", "s", 9), (2, text, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, text, "en", "s", 9), (5, text + "\n�é", "x", "y", 1), (5, text, "x", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, sf_dir)
            some = spark.createDataFrame(some.collect(), some.schema)
    assert some.count() == 0


@pytest.mark.parametrize("stage", ["line_dedup", "near_dedup", "suffix_dedup"])
def test_clean_documents_stay_as_they_are(spark, sf_dir, stage):
    docs = spark.createDataFrame([(i, "\n".join(f"line {k} of document {i} says {i * 31 + k * 17}" for k in range(6)), "en", "s", 0) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    found = getattr(corpus_pipeline, stage)(spark, docs, sf_dir)
    assert {(r["doc_id"], r["text"]) for r in found.collect()} == {(r["doc_id"], r["text"]) for r in docs.collect()}


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_line_stage_takes_long_passages_of_one_and_two_lines(spark, sf_dir):
    one, two = " ".join(f"a{i}" for i in range(60)), "\n".join(" ".join(f"{c}{i}" for i in range(30)) for c in "bc")
    texts = [one, f"x\n{two}\ny", "short line", one, f"{two}\nz", f"short line\n{one}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, sf_dir).collect()} == {0: one, 1: texts[1], 2: "short line", 4: "z", 5: "short line"}


def test_suffix_stage_keeps_characters_that_dont_repeat(spark, sf_dir):
    """U+FFFD of the input stays; a character of which only the first byte repeats goes whole, at both ends."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = [f"ü{base}é", f"a \ufffd b è\ufffd|¼{base}è\ufffd c", f"{base[:90]}\ufffd"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, sf_dir).collect()} == {0: texts[0], 1: "a \ufffd b è\ufffd|\ufffd c", 2: texts[2]}
