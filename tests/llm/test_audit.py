"""The audit of filters against sets of rows in plain Python."""

import itertools
import math
import random
import re

import pytest

from tesserae.llm import audit
from tesserae.llm.scratch import Scratch

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, names):
    """rows: (part, failed names, marks). Each order applied to the rows one filter after another."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations(names):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), *(sum(m in r[2] for r in gone) for m in ("good", "toxic"))]
    for part in {k[0] for k in out}:
        for f in names:
            every = sum(v[1] for (p, order, step), v in out.items() if p == part and order[step - 1] == f)
            for (p, order, step), v in out.items():
                if p == part and order[step - 1] == f:
                    v.append(every)
    return out


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_against_every_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), *(rng.random() < 0.3 if rng.random() < 0.9 else None for _ in range(5))) for _ in range(300)] + [("z", False, False, False, False, False)]
    df = spark.createDataFrame(rows, "part string, P boolean, Q boolean, R boolean, good boolean, toxic boolean").selectExpr("*", "1 as removed", "'a' as state")
    want = plain([(r[0] or "", {n for n, v in zip("PQR", r[1:4]) if v}, {n for n, v in zip(("good", "toxic"), r[4:]) if v}) for r in rows], "PQR")
    found = got(audit.audit(df, list("PQR"), "part", ["good", "toxic"]))
    assert found == want and len(found) == 4 * math.factorial(3) * 3
    assert audit.audit(df.where("false"), ["P"], "part").count() == 0
    with pytest.raises(ValueError):
        audit.audit(df, [], "part")


def test_states_are_visited_once_and_released(spark, monkeypatch):
    made = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: made.append(name) or keep(self, df, name))
    df = spark.createDataFrame([("x", True, False, True, False)], "part string, a boolean, b boolean, c boolean, d boolean")
    assert audit.audit(df, list("abcd"), "part").count() == 96
    assert len(made) == len(set(made)) == 2**4 - 1
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_failures_of_texts():
    rng = random.Random(5)

    def slow(text):
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        return len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text))

    for _ in range(200):
        text = "".join(rng.choice(["é", "a", "B", " ", "\n", "\x0b", " ", "\x1c", "#" if rng.random() < 0.01 else "b", "\x85", "w "]) for _ in range(rng.randrange(600)))
        assert audit.failures(text.encode()) == slow(text)
    assert audit.failures(b"") == (True, False, False, False)


def test_words_of_long_texts(monkeypatch):
    rng = random.Random(7)
    texts = [b" ".join(b"w%d" % rng.randrange(900) for _ in range(5000)), b"x" * 9000, b"  " * 9000, b"\n".join(b"v%d" % i for i in range(3000)) + b"\t"]
    want = [audit.count_words(t) for t in texts]
    monkeypatch.setattr(audit, "PORTION", 100)
    assert [audit.count_words(t) for t in texts] == want == [(5000, want[0][1]), (1, 1), (0, 0), (3000, 3000)]


def test_verdicts_of_odd_rows(spark):
    docs = [(1, "a b", "en"), (2, "a b", None), (2, "a b", "en"), (None, "a b", "en"), (3, None, "en"), (4, "", "en"), (None, "c", "en"), (None, "c", "en"), (5, "d", "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as digest", "2 as first", "true as A")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, 1)], LABELS)
    room = Scratch(spark, "audit")
    rows = audit.verdicts(docs, labels, room)
    assert rows.columns == ["part", *"ABCDE", "good", "toxic"] and rows.count() == 9
    assert sorted((r["part"], r["E"], r["good"], r["toxic"]) for r in rows.collect()) == sorted(
        [("en", False, True, True), ("", True, False, False), ("en", True, False, False), ("en", True, False, False), ("en", False, False, True), ("en", True, False, False), ("en", False, False, False), ("en", False, False, False), ("", False, False, False)]
    )
    assert audit.verdicts(docs.where("false"), labels, Scratch(spark, "audit")).count() == 0
