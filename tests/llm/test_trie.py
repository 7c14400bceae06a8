"""The prefix trie against nodes that are dictionaries of members."""

import hashlib
import random
import zlib

import pytest

from tesserae.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Rows without ties."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1])):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in members if p}
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(rebuilt[c]) == len(path)))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), sum(p[:-1] == path for p in members if p), sum(p not in inner for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    return sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as key", "'x' as base", "2 as turns")).collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_nodes(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 4)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 60), 60):
        rows += [(c, i if i else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None])) for i in range(rng.randrange(1, 14))]
    rows += [(c, i, "user", "hot") for c in range(100, 140) for i in range(3)] + [(None, 1, "user", "a"), (7_000, 0, "", None)]
    rows += [(9_000, i, "user", f"turn {i // 2}") for i in range(700)]
    rng.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_turnless_conversations_and_repeated_turns(spark):
    alone = next(c for c in range(10_001, 10_900) if c % 5 and trie.shared_turns(c) > 3)
    assert got(spark, [(alone, 1, "user", "a")]) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    same = [(0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a")]
    found = got(spark, same)
    assert found == got(spark, same[::-1]) and len(found) == 4
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "a")]) == []
