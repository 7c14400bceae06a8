"""Toxicity, lines, packing, conversations and archives."""

import gzip
import io
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat, lines, packing, toxicity, warc
from tesserae.llm.scratch import Scratch
from tests.compare import same_rows


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert ((found["score"] >= 0) & (found["score"] <= 1)).all() and (found["predicted"] == (found["score"] >= 0.5)).all()
    apart = found[found["held_out"]]
    order = apart["score"].rank()
    y = apart["toxic"]
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert len(apart) > 30 and auc > 0.9 and (apart["predicted"] == y).mean() > 0.93


def test_held_out_rows_and_nulls_dont_train(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(None, 1), (3, None), (7, 0)], "doc_id long, toxic int")
    taken = toxicity.sample(labels, 1000).join(spark.range(1000).select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("apart")), "doc_id").collect()
    assert taken and not any(r["apart"] for r in taken) and all(r["toxic"] == 1 for r in taken)
    assert toxicity.sample(labels, 10).count() == 10


def test_scores_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "word " * 250_000, "z"), (3, "!!!", None)], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none)
    assert [r["toxicity"] for r in toxicity.score(docs, model).collect()] == [0.0] * 4
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score(docs, toxicity.fit(docs, one)).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_features_see_hidden_words():
    tool = toxicity.Extractor({"idiot": 8.0})

    def at(text, name):
        return tool.features(text)[toxicity.FEATURES.index(name)]

    assert at("you idiot", "near_count") == 1 and at("idiot", "near_count") == 0
    assert all(at(t, "hidden_count") == 1 for t in ("1d10t", "idiooooot", "i-d-i-o-t")) and at("idiot", "hidden_count") == 0
    assert at("an i d i o t here", "spaced_count") == 1
    assert at("IDIOT!!", "all_caps_rate") == 1 and at("IDIOT!!", "exclaim_rate") == 2


def plain_features(text, lexicon):
    """What FEATURES say, token by token over the whole text."""
    tokens = text.split()
    n = len(tokens)
    rows = [toxicity.Extractor(lexicon).row(t) for t in tokens]
    named = {name: [r[i] for r in rows] for i, name in enumerate(toxicity.PER_TOKEN)}
    hits, persons = ([i for i, v in enumerate(named[k]) if v > 0] for k in ("weight", "second"))
    gaps = [min(abs(h - p) for p in persons) for h in hits] if persons else []
    near = sum(g <= toxicity.NEAR for g in gaps)
    kinds = {toxicity.plain_letters(t) for t, v in zip(tokens, named["strong"], strict=True) if v}
    runs = "".join(toxicity.word(t) if v else " " for t, v in zip(tokens, named["single"], strict=True)).split()
    spaced = sum(any(w in run for w in lexicon if len(w) >= 3 and w[0] != "^") for run in runs)
    total = {k: sum(v) for k, v in named.items()}
    letters = max(1.0, total["letters"])
    by_word = {
        "weight_rate": "weight", "lexicon_rate": "lexicon", "strong_rate": "strong", "hidden_rate": "hidden", "second_rate": "second", "all_caps_rate": "all_caps", "mixed_rate": "mixed",
        "stretched_rate": "stretched", "single_rate": "single", "exclaim_rate": "exclaim", "question_rate": "question", "star_rate": "stars", "mark_rate": "marks",
    }
    out = {k: total[v] / n for k, v in by_word.items()}
    out |= {"log_words": np.log1p(n), "weight_sum": total["weight"], "lexicon_count": total["lexicon"], "strong_count": total["strong"], "strong_kinds": len(kinds), "hidden_count": total["hidden"], "spaced_count": spaced}
    out |= {"near_count": near, "near_rate": near / n, "nearest": 1 / (1 + min(gaps)) if gaps else 0, "upper_rate": total["upper"] / letters, "mean_word": letters / n, "max_weight": max(named["weight"])}
    return [out[k] for k in toxicity.FEATURES]


@pytest.mark.parametrize("piece", [1, 3, 40, 1 << 18])
def test_features_of_pieces_equal_a_plain_version(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    monkeypatch.setattr(toxicity, "KEPT", max(50, piece))
    lexicon = {"idiot": 8.0, "fool": 3.0, "^stupi": 5.0}
    some = ["idiot", "fool", "stupid", "stupidly", "1d10t", "you", "your", "i", "d", "o", "t", "a", "word", "WORD!!", "what?", "s***", "x" * 200, "hellooo", "and", "so", "on", "\u00a0", "\u2003"]
    rng = random.Random(piece)
    tool = toxicity.Extractor(lexicon)
    for weights in ([1] * len(some), [1 if t in ("idiot", "you", "1d10t") else 12 for t in some], [9 if len(t) == 1 else 1 for t in some]):
        for size in (1, 2, 30, 400):
            text = "".join(t + rng.choice([" ", "  ", "\n", "\t\n ", "\x1c"]) for t in [*rng.choices(some, weights, k=size), "end"])
            assert np.allclose(tool.features(text), plain_features(text, lexicon), rtol=1e-12)
    assert tool.features("you i d i " + "o t " * 3 + "x " * 40 + "i d i o t")[toxicity.FEATURES.index("spaced_count")] == 1
    assert tool.features(" \n ") == [0.0] * len(toxicity.FEATURES)


def test_memory_of_a_very_long_text():
    """Features are added up by pieces; what is kept of a text doesn't grow with it, of whatever tokens it is."""
    tool = toxicity.Extractor({"idiot": 8.0})
    peaks = []
    for text in ("some words you idiot a b " * 40_000, "some words you idiot a b " * 160_000, " ".join(f"w{i}" for i in range(500_000))):
        tracemalloc.start()
        tool.features(text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] and max(peaks) < 120_000_000
    assert not any(isinstance(t, str) and len(t) > toxicity.KEPT_LENGTH for t in tool.at)


def test_a_split_is_the_best_of_all_limits():
    """The first split of a tree of one level has the largest gain among all features and bin edges."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 3)), 1)
    y = (x[:, 1] + 0.8 * rng.normal(size=400) > 0.4).astype(float)
    tree = toxicity.fit_trees(x, y, n_trees=1, depth=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    g, h = y - p, np.full(400, p * (1 - p))

    def gain(j, limit):
        right = x[:, j] > limit
        if right.sum() < 8 or (~right).sum() < 8:
            return 0.0
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (right, ~right)) - g.sum() ** 2 / (h.sum() + 1.0)

    best = max(gain(j, limit) for j in range(3) for limit in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])))
    assert np.isclose(gain(tree.feature[0, 0], tree.limit[0, 0]), best)


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    raw = toxicity.fit_trees(x, y, n_trees=60).raw(x)
    assert ((raw > 0) == y).mean() > 0.95
    at, share = toxicity.fit_isotonic(raw, y)
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all()


def brute_lines(docs, run=lines.RUN):
    """Numbers of the lines that go, by a set of all strings of lines before."""
    seen, out = set(), {}
    for name, text in sorted(docs):
        every = (text or "").split("\n")
        own = [i for i, line in enumerate(every) if line.strip(lines.BLANK)]
        gone = set()
        for s in range(len(own) - run + 1):
            part = tuple(every[i] for i in own[s : s + run])
            if part in seen:
                gone |= set(own[s : s + run])
            seen.add(part)
        out[name] = (len(gone), text if not gone else "\n".join(line for i, line in enumerate(every) if i not in gone))
    return out


def test_lines_equal_a_set_of_all_strings(spark):
    rng = np.random.default_rng(2)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "", " \t", "long line", "d"], rng.integers(0, 14)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "\n\n\n\n"), (503, "same\n" * 400), (504, "a\r\nb\r\nc\r\n"), (505, "a\r\nb\r\nc\r\n"), (506, "x" * 200_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["removed"], r["text"]) for r in lines.remove_repeated_lines(spark, frame).collect()}
    assert got == brute_lines(docs)


def brute_passages(docs, words):
    """Lines and texts by a set of all strings of RUN lines, and of fewer with so many words, before."""
    seen, out = set(), {}
    for name, text in sorted(docs):
        every = (text or "").split("\n")
        own = [i for i, line in enumerate(every) if line.strip(lines.BLANK)]
        gone = set()
        for run in range(1, lines.RUN + 1):
            for s in range(len(own) - run + 1):
                part = tuple(every[i] for i in own[s : s + run])
                if run == lines.RUN or sum(len(p.split()) for p in part) >= words:
                    if part in seen:
                        gone |= set(own[s : s + run])
                    seen.add(part)
        out[name] = (len(gone), text if not gone else "\n".join(line for i, line in enumerate(every) if i not in gone))
    return out


def test_long_passages_of_one_and_two_lines_go(spark):
    rng = np.random.default_rng(5)
    some = [" ".join(f"w{k}-{i}" for i in range(n)) for k, n in enumerate([1, 3, 24, 26, 30, 49, 50, 51, 400])] + ["", " \t"]
    docs = [(i, "\n".join(rng.choice(some, rng.integers(0, 5)))) for i in range(120)]
    docs += [(500, None), (501, some[8]), (502, "\n" + some[8] + "\n\n"), (503, f"{some[3]}\n\n{some[2]}"), (504, f"x\n{some[3]}\n{some[2]}"), (505, some[5]), (506, some[5])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["removed"], r["text"]) for r in lines.remove_repeated_lines(spark, frame, 50).collect()}
    assert got == brute_passages(docs, 50) != brute_lines(docs)


def test_line_query_equals_its_sql_on_odd_spaces(spark, tmp_path):
    """Tabs, vertical tabs, form feeds and carriage returns part words; other white space, as of other scripts, doesn't."""
    gaps = [" ", "\t", "\x0b", "\x0c", "  \r ", "\u00a0", "\u2003", "\x1c", "\x85"]
    some = [gap.join(f"w{k}-{i}é" for i in range(n)) for k, gap in enumerate(gaps) for n in (25, 49, 50)] + ["", "\x0b", " \r", "\u00a0"]
    rng = np.random.default_rng(8)
    docs = {i: "\n".join(rng.choice(some, rng.integers(0, 6))) for i in range(300)} | {500: None, 501: "", 502: some[2] + "\r\n" + some[2]}
    pq.write_table(pa.table({"doc_id": pa.array(docs.keys(), pa.int64()), "text": pa.array(docs.values(), pa.string())}), f"{tmp_path}/documents.parquet")
    found = lines.op5_lines(spark, str(tmp_path))
    assert found.where("n_removed > 0").count() > 100
    same_rows(found, lines.ORACLES["op5_lines"], str(tmp_path))


def test_lines_of_repeated_and_null_ids(spark):
    text = "one\ntwo\nthree\nfour"
    rows = [(1, text, "k", 0), (1, text, "k", 1), (None, text, None, 2), (2, "zero\n" + text, "k", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, at int")
    got = {r["at"]: (r["removed"], r["text"], r["key"]) for r in lines.remove_repeated_lines(spark, docs).collect()}
    assert got == {0: (0, text, "k"), 1: (0, text, "k"), 2: (4, "", None), 3: (4, "zero", "k")}
    assert lines.remove_repeated_lines(spark, docs.where("false")).count() == 0


def plain_packing(items, capacity):
    """All open bins looked through for each item."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set(), "n": 0})
        b = bins[i]
        out.append((i, b["n"]))
        b["left"] -= size
        b["n"] += 1
        b["s"] |= {source} - {None}
        b["c"] |= {cluster} - {None}
    return out


@pytest.mark.parametrize("seed", range(8))
def test_packing_equals_a_look_through(seed):
    rng = np.random.default_rng(seed)
    items = sorted(((int(rng.integers(1, 60)), rng.choice(["a", "a", "b", "c", None]), rng.choice([*map(str, range(30)), None])) for _ in range(300)), key=lambda t: -t[0])
    assert packing.pack_items(items, 64) == plain_packing(items, 64)


def test_packed_documents_are_whole_and_compatible(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, capacity=500, shard=64).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    words, bins = {}, {}
    for r in rows:
        words.setdefault((r["doc_id"], len(r["text"].split())), []).append((r["start"], r["n_words"]))
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for (_, n), pieces in words.items():
        assert sum(p[1] for p in pieces) == n
        at = 0
        for start, size in sorted(pieces):
            assert start == at
            at += size
    for own in bins.values():
        assert sum(r["n_words"] for r in own) <= 500 and sorted(r["slot"] for r in own) == list(range(len(own)))
        sources, texts = [r["source"] for r in own], [" ".join(r["text"].lower().split()) for r in own]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "k"), (2, "  ", "s", "k"), (None, "a b", "s", "k"), (3, "a b c", None, "k"), (3, "a b c", None, "k"), (4, "w " * 5000, "s", "k")], "doc_id long, text string, source string, n string")
    rows = packing.pack_documents(docs).collect()
    assert sum(r["n_words"] for r in rows) == 5008 and sum(r["bin_id"] is None for r in rows) == 2 and len(rows) == 8
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_rows_without_an_id_and_of_one_id_are_spread(spark):
    rows = [(None if i < 2000 else 7 if i < 4000 else i, "a b" if i % 2 else f"w{i} x", "s") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    groups = spark.createDataFrame([(7, 7)], "doc_id long, cluster long")
    for given in (groups, None):
        placed = packing.pack_documents(docs, shard=100, groups=given)
        sizes = [r["count"] for r in placed.groupBy(F.shiftright("bin_id", 32)).count().collect()]
        assert sum(sizes) == 8000 and max(sizes) < 200
        assert placed.where("doc_id is null").count() == placed.where("doc_id = 7").count() == 2000
    # Lots of more than one document, more of them than are written out at once, and none lost.
    alike = spark.createDataFrame([(1, "s", 2, None, 3_000_001), (2, None, 2, "c", 1)], "key long, source string, n long, cluster string, copies long")
    lots = packing.dealt(alike, 64 * 100, 500)
    assert {r["key"]: r["sum(copies)"] for r in lots.groupBy("key").sum("copies").collect()} == {1: 3_000_001, 2: 1}
    assert max(r["sum(copies)"] for r in lots.groupBy("shard").sum("copies").collect()) < 2 * 6000


def test_near_copies_without_an_id_share_no_bin(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join([*words, f"end{i}"]), f"s{i}") for i in range(4)] + [(5, " ".join(words), "s9"), (None, "other words here", "s8")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    placed = packing.op7_packing(spark, str(tmp_path)).collect()
    near = [r["bin_id"] for r in placed if r["n_words"] >= 60]
    assert len(placed) == 6 and len(near) == len(set(near)) == 5


def test_pairs(spark):
    turn = "array<struct<role: string, text: string>>"
    user, good, bad = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [user, good], [user, bad]), (2, [user], [user]), (3, None, [bad]), (4, [user, good], [user]), (5, [good], [user])]
    got = {r["pair_id"]: r for r in chat.format_pairs(spark.createDataFrame(rows, f"pair_id long, chosen {turn}, rejected {turn}")).collect()}
    assert got[1]["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and got[1]["n_common"] == 1
    for name, text in (("chosen", "yes"), ("rejected", "no")):
        begin, end = map(int, got[1][f"{name}_mask"].split("-"))
        assert got[1][f"{name}_completion"][begin:end] == text + "<|im_end|>\n"
    assert got[2]["chosen_completion"] == got[2]["rejected_completion"] == got[2]["chosen_mask"] == ""
    assert got[3]["prompt"] == "" and got[3]["chosen_completion"] == "" and got[3]["rejected_mask"]
    assert got[4]["rejected_completion"] == "" and got[4]["n_common"] == 1
    assert got[5]["n_common"] == 0 and got[5]["rejected_mask"] == ""


def test_conversations_of_odd_rows(spark):
    rows = [(0, 1, "assistant", "b", 1), (0, 0, "user", None, 1), (0, 0, None, "c", 1), (None, 0, "user", "x", 1), (1, None, "user", "q", 1), (7, 0, "assistant", "z", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, other int")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.conversations(turns).collect()}
    assert got == {0: [("", "c"), ("user", ""), ("assistant", "b")], 1: [("user", "q")], 7: [("assistant", "z")]}
    pairs = {r["pair_id"]: r for r in chat.format_pairs(chat.swapped_pairs(turns)).collect()}
    assert pairs[0]["n_common"] == 2 and pairs[0]["rejected_completion"] == ""
    assert pairs[1]["n_common"] == 1 and "b<|im_end|>" in pairs[1]["rejected_completion"]
    assert chat.format_pairs(chat.swapped_pairs(turns.where("false"))).count() == 0


def test_members_are_read_in_turn():
    parts = [b"a" * 10, b"", b"xyz" * 100_000]
    stream = io.BytesIO(b"".join(warc.member(p) for p in parts))
    assert list(warc.members(stream)) == parts
    assert gzip.decompress(stream.getvalue()) == b"".join(parts)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(warc.member(b"abc" * 1000)[:-9])))


def test_records_are_framed_and_verified():
    own = warc.record(5, "http://a/\r\nX: y", "é\r\n\r\nb".encode(), None, False, "2020-01-01T00:00:00Z")
    found = warc.parse(own)
    assert found["page_id"] == 5 and found["payload"] == "é\r\n\r\nb".encode() and found["payload_bytes"] == 7 and found["url"] == "http://a/X: y"
    for wrong in (own.replace(b"\xc3\xa9", b"ee"), own[:-1], b"WARC/0.1" + own[8:]):
        with pytest.raises(ValueError):
            warc.parse(wrong)
    again = warc.parse(warc.record(4, None, b"abc", 9, True, "2020-01-01T00:00:00Z"))
    assert (again["record_type"], again["refers_to"], again["payload"], again["payload_bytes"], again["payload_digest"]) == ("revisit", 9, None, 3, warc.digest(b"abc"))


def test_rows_without_a_number_and_equal_payloads(spark):
    pages = spark.createDataFrame([(None, "u", "x"), (None, "v", "x"), (None, "u", None), (3, "u", "y"), (None, "u", "y")], "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(spark, pages).collect()), key=repr)
    x, y, none = (warc.digest(t) for t in (b"x", b"y", b""))
    assert got == sorted([(None, x, "response", None)] * 2 + [(None, none, "response", None), (3, y, "response", None), (None, y, "revisit", 3)], key=repr)


def foreign(kind, block, *more):
    head = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-000000000001>", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.0", *head]).encode() + warc.END + block + warc.END


def test_records_of_other_writers():
    info = warc.parse(foreign("warcinfo", b"software: x\r\n"))
    assert (info["page_id"], info["record_type"], info["payload"], info["payload_bytes"]) == (None, "warcinfo", b"software: x\r\n", 13)
    bare = warc.parse(foreign("response", b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\nbody"))
    assert (bare["payload"], bare["payload_bytes"], bare["payload_digest"]) == (b"body", 4, warc.digest(b"body"))
    coded = warc.parse(foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n", f"WARC-Payload-Digest: sha1:{warc.digest(b'body')}"))
    assert coded["payload"].startswith(b"4\r\n") and coded["payload_digest"] == warc.digest(b"body")
    again = warc.parse(foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <urn:uuid:2>"))
    assert (again["payload"], again["payload_bytes"], again["refers_to"]) == (None, None, None)
    for wrong in (foreign("response", b"x").replace(b"Content-Length", b"Length"), foreign("resource", b"abc", f"WARC-Block-Digest: sha1:{warc.digest(b'x')}"), b"x" * 3 * warc.HEAD):
        with pytest.raises(ValueError):
            warc.parse(wrong)


def test_content_length_bounds_what_is_inflated():
    """A member of many zeros after its record is given up after a chunk or two."""
    own = warc.record(1, None, b"abc", None, False, "2020-01-01T00:00:00Z")
    stream = io.BytesIO(warc.member(own + bytes(200 << 20), 1))
    chunks, size = next(warc.inflated(stream)), 0

    def counted():
        nonlocal size
        for chunk in chunks:
            size += len(chunk)
            yield chunk

    with pytest.raises(ValueError):
        warc.framed(counted())
    assert size <= 3 * warc.CHUNK
    two = io.BytesIO(warc.member(own) + warc.member(own))
    assert [warc.framed(c)[0]["warc-type"] for c in warc.inflated(two)] == ["response"] * 2


@pytest.mark.parametrize("least", [0, 2])
def test_archives_round_trip(spark, least):
    rows = [(1, "u", "x", 0), (3, "u", "x", 0), (3, "v", "x", 0), (2, None, None, 0), (5, "u", "", 0), (None, "u", "abc", 0), (9, "u", "abc", 0), (10, "u", "q" * 300_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted(((r["page_id"] is None, r["page_id"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in warc.warc_round_trip(spark, pages, least).collect()), key=repr)
    short = {(1, "x"): 3, (2, ""): 5} if least == 0 else {}
    want = []
    for page, _, html, _ in rows:
        html = html or ""
        to = 9 if page is None else short.get((page, html))
        want.append((page is None, page, "response" if to is None else "revisit", to, html if to is None else None))
    assert got == sorted(want, key=repr)
    assert warc.warc_round_trip(spark, pages.where("false")).count() == 0


def test_archives_are_cut_by_size(spark):
    room = Scratch(spark, "test")
    pages = spark.range(0, 50, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    manifest = room.keep(warc.write_archives(pages, f"{room.path}/archives", max_archive_bytes=2000), "manifest")
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == 50
    assert warc.read_archives(manifest).select("page_id").distinct().count() == 50


def test_lines_run_without_python(spark, sf_dir):
    text = lines.op5_lines(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "InArrow" not in text
