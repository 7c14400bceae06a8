"""The stages of the pipeline against plain-Python versions: toxicity alone, the others each on what the one before kept."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import minhash, packing, suffixes, toxicity
from tests.llm import test_minhash, test_suffixes, test_texts


def by_id(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def without_empty(before, after, changed):
    return {d: t for d, t in after.items() if d not in changed or (t or "").strip()}


def whole_characters(text, spans):
    """text without the characters that lose a byte."""
    out, at = [], 0
    gone = np.zeros(len(text.encode()) + 1, bool)
    for a, b in spans:
        gone[a:b] = True
    for c in text:
        size = len(c.encode())
        if not gone[at : at + size].any():
            out.append(c)
        at += size
    return "".join(out)


def test_toxicity_stage_equals_scores_of_single_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    tool, before = toxicity.Extractor(model.lexicon), by_id(docs.collect())
    clean = {d: t for d, t in before.items() if model.score(np.array([tool.features(t)]))[0] < corpus_pipeline.TOXIC}
    assert by_id(corpus_pipeline.toxicity(spark, docs, sf).collect()) == clean and 0 < len(clean) < len(before)


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = by_id(docs.collect())

    lines = test_texts.brute_passages(clean.items(), corpus_pipeline.PASSAGE)
    cut = without_empty(clean, {d: t for d, (_, t) in lines.items()}, {d for d, (n, _) in lines.items() if n})
    rows = corpus_pipeline.line_dedup(spark, docs, sf_dir).collect()
    assert by_id(rows) == cut != clean
    docs = spark.createDataFrame(rows, docs.schema)

    kept = {d for d, _, c in test_minhash.brute(list(cut.items())) if d == c}
    rows = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert by_id(rows) == {d: cut[d] for d in kept} != cut
    docs = spark.createDataFrame(rows, docs.schema)

    spans = {d: s for d, (_, s) in test_suffixes.brute([(d, cut[d]) for d in kept]).items()}
    rest = without_empty(cut, {d: whole_characters(cut[d] or "", spans[d]) for d in kept}, {d for d, s in spans.items() if s})
    rows = corpus_pipeline.suffix_dedup(spark, docs, sf_dir).collect()
    assert by_id(rows) == rest != {d: cut[d] for d in kept}
    docs = spark.createDataFrame(rows, docs.schema)

    source = {r["doc_id"]: r["source"] for r in rows}
    items, want = [], set()
    for d, text in rest.items():
        n = len(text.split())
        want |= {(d, p, p * packing.CAPACITY, packing.CAPACITY, 0) for p in range(n // packing.CAPACITY)} | ({(d, 0, 0, 0, None)} if not n else set())
        if n % packing.CAPACITY:
            items.append((-(n % packing.CAPACITY), d, n // packing.CAPACITY, source[d], " ".join(text.lower().split())))
    items.sort(key=lambda r: r[:2])
    placed = test_texts.plain_packing([(-n, s, c) for n, _, _, s, c in items], packing.CAPACITY)
    want |= {(d, p, p * packing.CAPACITY, -n, slot) for (n, d, p, _, _), (_, slot) in zip(items, placed, strict=True)}
    found = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["n_words"], r["slot"]) for r in found} == want
    bins = {}
    for (_, d, p, _, _), (b, _) in zip(items, placed, strict=True):
        bins.setdefault(b, set()).add((d, p))
    together = {}
    for r in found:
        if r["bin_id"] is not None:
            together.setdefault(r["bin_id"], set()).add((r["doc_id"], r["piece"]))
    full = {(d, p) for d, p, _, size, _ in want if size == packing.CAPACITY} - {x for b in bins.values() for x in b}
    assert sorted(map(sorted, bins.values())) == sorted(sorted(b) for b in together.values() if not b <= full)


def test_near_duplicates_of_op7_never_share_a_bin(spark, sf_dir):
    near = {r["doc_id"]: r["component_id"] for r in minhash.op6_minhash(spark, sf_dir).collect()}
    bins = {}
    for r in packing.op7_packing(spark, sf_dir).collect():
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(near[r["doc_id"]])
    assert all(len(set(b)) == len(b) for b in bins.values()) and any(len(b) > 1 for b in bins.values())


def test_groups_of_packing_by_table(spark):
    docs = spark.createDataFrame([(i, f"word{i} x", f"s{i}") for i in range(6)] + [(None, "a b", "t"), (3, "other one", "u")], "doc_id long, text string, source string")
    groups = spark.createDataFrame([(0, "g"), (1, "g"), (2, "g"), (2, "a"), (None, "g")], "doc_id long, cluster string")
    rows = packing.pack_documents(docs, groups=groups).collect()
    at = {r["doc_id"]: r["bin_id"] for r in rows}
    assert len(rows) == 8 and at[0] != at[1] and at[2] == at[0] and at[4] == at[5] == at[0]


@pytest.mark.parametrize("seed", range(4))
def test_isotonic_equals_the_min_max_formula(seed):
    """A pool's share of label 1 is the largest of the least means over all ranges around it."""
    rng = np.random.default_rng(seed)
    raw = np.sort(rng.normal(size=60))
    y = (rng.random(60) < 1 / (1 + np.exp(-raw))).astype(float)
    at, share = toxicity.fit_isotonic(raw, y)
    plain = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    cuts = np.flatnonzero(np.diff(plain) > 1e-12) + 1
    pools = np.split(np.arange(60), cuts)
    assert at == pytest.approx([raw[p].mean() for p in pools])
    assert share == pytest.approx(np.clip([(y[p].sum() + 0.02) / (len(p) + 0.04) for p in pools], 0.001, 0.999))


def test_a_first_split_is_the_best_of_all(spark):
    """One tree of one split against all thresholds of all features."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, size=(400, 3)).astype(float)
    y = ((x[:, 1] >= 5) ^ (rng.random(400) < 0.1)).astype(float)
    raw = toxicity.fit_trees(x, y, n_trees=1).raw(x)
    assert (raw[x[:, 1] >= 5].min() > raw[x[:, 1] < 5].max())


def test_calibration_rows_stay_out_of_the_lexicon(spark):
    """A word of toxic calibration rows only is in no lexicon."""
    ids = [i for i in range(600)]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("apart", toxicity.apart()).collect()
    apart = {r["doc_id"] for r in frame if r["apart"]}
    rows = [(i, ("vileword " if i % 2 else "nice ") + ("hiddenword" if i in apart and i % 2 else "") + f" text {i}") for i in ids]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels).lexicon
    assert "vileword" in lexicon and "hiddenword" not in lexicon and 0 < len(apart) < 600
    assert docs.where(F.col("text").contains("hiddenword")).count() > 20 and suffixes.LENGTH == 100
