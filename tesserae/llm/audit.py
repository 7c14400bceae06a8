"""What each filter removes in each order of all filters, by a trie of permutations.

A prefix of an order leaves the same documents as any other order of its letters, so the trie of n! orders has 2^n states:

1. every document is judged once by every filter, and its verdicts with its part and marks are written as a table;
2. the trie is walked depth-first: the documents that survive a state are a persisted DataFrame, made of its parent's by one
   filter. One aggregate of it counts, for every edge that leaves the state, what that edge's filter removes, what it keeps and
   which marks go. A state that another order has reached already isn't visited again, and its documents are released when the
   walk leaves it, so as many are held as there are filters;
3. orders look their edges up: of a filter's removals in the empty state those at its own edge are not yet made, the others are
   redundant; at the edge from the state of all other filters it removes what it alone finds.

Nothing is collected: counts of edges are tables of a row for each part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import blake2b, sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.columns import named
from tesserae.llm.scratch import Scratch

#: Filters at most: there are n! orders of n filters.
MOST_FILTERS = 7
#: Bytes of a text whose words are held at once.
PORTION = 1 << 20
#: Limits of op11's filters: words, distinct words of 100 words, capitals of 100 characters.
WORDS, DISTINCT, CAPITALS = 100, 80, 10

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SPECIAL = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_WITHIN = bytes(range(0x80, 0xC0))
JUDGED = "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary"


def portions(text: bytes) -> Iterator[bytes]:
    """Parts of about PORTION bytes that cut no word."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PORTION)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def count_words(text: bytes) -> tuple[int, int]:
    """Words and distinct words. Those of a text over PORTION bytes are told apart by 16 bytes of a digest, so memory grows by 16 bytes a distinct word."""
    if len(text) <= PORTION:
        words = text.split()
        return len(words), len(set(words))
    total, done, waiting, n = 0, np.zeros(0, "V16"), [], 0
    for part in portions(text):
        words = part.split()
        total += len(words)
        waiting.append(np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in set(words)), "V16"))
        n += len(waiting[-1])
        if n > len(done):
            done, waiting, n = _united([done, *waiting]), [], 0
    return total, len(_united([done, *waiting]))


def _united(parts: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate(parts).view(np.uint64).reshape(-1, 2)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return np.ascontiguousarray(pairs[new]).view("V16").ravel()


def failures(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Whether a text fails the filters A to D of op11."""
    n, distinct = count_words(text)
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _WITHIN))
    return n < WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * points, _SPECIAL.search(text) is not None


def judged(docs: DataFrame) -> DataFrame:
    """JUDGED of docs (doc_id, lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, digests = [], []
            for x in batch.column(2):
                text = (x.as_py() or "").encode("utf-8")
                found.append(failures(text))
                digests.append(sha256(text).digest())
            flags = [pa.array([f[k] for f in found], pa.bool_()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *flags, pa.array(digests, pa.binary())], ["doc_id", "part", "A", "B", "C", "D", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), "text").mapInArrow(run, JUDGED)


def verdicts(docs: DataFrame, labels: DataFrame, room: Scratch) -> DataFrame:
    """part, A to E (whether a document fails that filter), good and toxic, of docs (doc_id, lang, text) and labels (doc_id, quality, toxic).

    A null text is empty, a null lang the empty string. E is failed by a text that a row with a smaller doc_id has; rows of the same
    doc_id don't fail by each other, and a null doc_id is larger than all others. Of a repeated doc_id in labels, any row with a 1
    counts. Adaptive execution splits the rows of a text that very many documents have."""
    each = room.keep(judged(docs), "judged")
    first = each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    found = each.join(first, "digest", "left").join(marks, "doc_id", "left")
    earlier = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    return room.keep(found.select("part", *"ABCD", earlier.alias("E"), *(F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic"))), "verdicts")


def edges(rows: DataFrame, filters: Sequence[str], part: str, marks: Sequence[str], room: Scratch) -> DataFrame:
    """part, state (bits of the filters applied before), filter (its number), removed, kept and for each mark the removed rows
    that have it: a row for each edge of the trie and each part that has rows in its state. Columns have plain names and no nulls."""
    seen: set[int] = set()

    def counted(survivors: DataFrame, state: int) -> DataFrame:
        def sums(k: int, f: str) -> str:
            lost = "".join(f", '{m}_lost', count_if({f} and {m})" for m in marks)
            return f"named_struct('filter', {k}, 'removed', count_if({f}), 'kept', count_if(not {f}){lost})"

        each = ", ".join(sums(k, f) for k, f in enumerate(filters) if not state >> k & 1)
        return survivors.groupBy(part).agg(F.expr(f"array({each})").alias("each")).selectExpr(part, "inline(each)")

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        survivors = survivors.persist()
        try:
            room.keep(counted(survivors, state), f"edges/state={state}")
            for k, f in enumerate(filters):
                after = state | 1 << k
                if after not in seen and after != (1 << len(filters)) - 1:
                    visit(after, survivors.where(f"not {f}"))
        finally:
            survivors.unpersist()

    visit(0, rows.select(part, *filters, *marks))
    return rows.sparkSession.read.parquet(f"{room.path}/edges")


def audit(rows: DataFrame, filters: Sequence[str], part: str, marks: Sequence[str] = (), room: Scratch | None = None) -> DataFrame:
    """What every order of filters removes of rows, at each step and in each part: part, filter_order (the filters' names joined),
    step (from 1), and as long kept (rows after the step), removed (at it), redundant (rows that fail its filter, removed before it),
    unique_fails (rows that fail its filter only), <mark>_lost (removed rows with the mark) and shapley (what its filter removes, summed
    over all orders).

    filters are boolean columns that are true where a row fails and marks are boolean ones; null is false. part is a column, whose null is
    the empty string. Each part has a row for each order and step, with zeros; a table without rows has no parts. Other columns don't
    matter. A filter's name is one of at most MOST_FILTERS, as there are n! orders."""
    if not filters or len(filters) > MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"between 1 and {MOST_FILTERS} different filters")
    spark = rows.sparkSession
    room = room or Scratch(spark, "audit")
    plain = rows.select(F.coalesce(named(part).cast("string"), F.lit("")).alias("part"), *(F.coalesce(named(c), F.lit(False)).alias(f"{kind}{i}") for kind, names in (("f", filters), ("m", marks)) for i, c in enumerate(names)))
    counts = edges(plain, [f"f{i}" for i in range(len(filters))], "part", [f"m{i}" for i in range(len(marks))], room)
    orders = [("".join(filters[k] for k in order), step + 1, order[step], sum(1 << k for k in order[:step])) for order in permutations(range(len(filters))) for step in range(len(filters))]
    steps = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter int, state int"))
    alone = counts.where(F.expr(f"state = {(1 << len(filters)) - 1} ^ shiftleft(1, filter)"))
    failed = counts.where("state = 0").select("part", "filter", F.col("removed").alias("failed"))
    failed = failed.join(alone.select("part", "filter", F.col("removed").alias("alone")), ["part", "filter"], "left")
    found = failed.join(steps, "filter").join(counts, ["part", "state", "filter"], "left")
    lost = [F.coalesce(f"m{i}_lost", F.lit(0)).cast("long").alias(f"{m}_lost") for i, m in enumerate(marks)]
    removed = F.coalesce("removed", F.lit(0)).cast("long")
    found = found.select("part", "filter_order", "step", "filter", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), removed.alias("removed"), (F.col("failed") - removed).alias("redundant"), F.coalesce("alone", F.lit(0)).cast("long").alias("unique_fails"), *lost)
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    room = Scratch(spark, "audit")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return audit(verdicts(docs, labels, room), list("ABCDE"), "part", ["good", "toxic"], room)


QUERIES = {"op11_audit": op11_audit}

#: Counts of documents by the set of filters that they fail, and orders of letters by joins.
ORACLES = {
    "op11_audit": r"""
with word as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
first as (select coalesce(text, '') as text, min(doc_id) as first from documents group by 1),
fail as (select part, len(words) < 100 as a, 100 * len(list_distinct(words)) < 80 * len(words) as b, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) as c,
                regexp_matches(text, '[#$%&*|]') as d, doc_id > first as e, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic
         from word join first using (text) left join labels using (doc_id)),
mask as (select part, concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end, case when d then 'D' else '' end, case when e then 'E' else '' end) as fails,
                count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from fail group by 1, 2),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select p.x || q.x || r.x || s.x || t.x as filter_order from letter p join letter q on q.x <> p.x join letter r on r.x not in (p.x, q.x)
           join letter s on s.x not in (p.x, q.x, r.x) join letter t on t.x not in (p.x, q.x, r.x, s.x)),
step as (select filter_order, i as step, substr(filter_order, i, 1) as x, substr(filter_order, 1, i - 1) as before from orders, range(1, 6) s(i)),
seen as (select part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) as failing, before <> '' and regexp_matches(fails, '[' || before || '-]') as gone from mask, step)
select *, sum(removed) over (partition by part, substr(filter_order, step, 1))::bigint as shapley
from (select part, filter_order, step::int as step, coalesce(sum(n) filter (not gone and not failing), 0)::bigint as kept, coalesce(sum(n) filter (not gone and failing), 0)::bigint as removed,
      coalesce(sum(n) filter (gone and failing), 0)::bigint as redundant, coalesce(sum(n) filter (fails = x), 0)::bigint as unique_fails,
      coalesce(sum(good) filter (not gone and failing), 0)::bigint as good_lost, coalesce(sum(toxic) filter (not gone and failing), 0)::bigint as toxic_lost
      from seen group by 1, 2, 3)"""
}
