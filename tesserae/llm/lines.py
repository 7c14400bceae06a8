"""Removal of repeated runs of lines by winnowing, in DataFrame operations only.

A line goes when a string of RUN lines that covers it also starts earlier: in a document with a smaller id, or before in
the same one. With a number of words, a string of fewer than RUN lines that has so many words goes by the same rule. Lines of
white space alone don't count and always stay. Of each RUN - GRAM + 1 neighbouring hashes of GRAM lines the least is selected,
so two equal strings of RUN lines have a fingerprint at the same place in both; a shorter string is its own fingerprint:

1. fingerprints are counted, pre-aggregated in each task; those that occur once are dropped by a semi-join;
2. around each other one the match is extended both ways: each string of RUN lines that holds the fingerprint is joined to
   where it starts first, which is a minimum by group, so no group of copies is gathered and no pair of them is made;
3. the strings that start later mark their lines, which makes maximal runs of them, and the documents lose these.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.columns import free, named
from tesserae.llm.scratch import Scratch

#: Lines of a run that is found for sure, and of a fingerprint.
RUN, GRAM = 3, 2
#: Words from which on a repeated run of fewer lines goes too, in op5_lines and the pipeline.
PASSAGE = 50
#: Keys with more than this part of all rows are joined apart.
HOT = 1000
#: Characters of lines that don't count.
BLANK = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _range(n: Column) -> Column:
    """0 .. n - 1; empty for n below 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _held(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once: a generator of one row. The optimizer would else put an array's expression
    into each filter above and into each lambda that looks something up in it, to run there for every element."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _counts(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANK)) != ""


def _counted(lines: Column) -> Column:
    """Numbers of the lines that aren't blank."""
    return F.filter(_range(F.size(lines)), lambda i: _counts(F.get(lines, i)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """id, own (a hash of the text), print (the fingerprint), base (the first line of around) and around: hashes of the lines that a string of RUN lines with the fingerprint can reach."""
    spread = RUN - GRAM
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), _lines(F.col("text")).alias("lines"))
    rows = rows.where(F.size("lines") >= RUN).select("id", "own", F.transform(F.filter("lines", _counts), lambda x: F.xxhash64(x)).alias("hashes"))
    rows = rows.where(F.size("hashes") >= RUN)
    grams = F.transform(_range(F.size("hashes") - (GRAM - 1)), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(GRAM))))
    rows = _held(rows, grams=grams)

    def least(s: Column) -> Column:
        window = F.slice("grams", s + 1, spread + 1)
        return (s + F.array_position(window, F.array_min(window)) - 1).cast("int")

    chosen = F.array_distinct(F.transform(_range(F.size("hashes") - (RUN - 1)), least))
    rows = rows.select("id", "own", "hashes", "grams", F.explode(chosen).alias("at"))
    base = F.greatest(F.col("at") - spread, F.lit(0))
    return rows.select("id", "own", F.get("grams", F.col("at")).alias("print"), base.alias("base"), F.slice("hashes", base + 1, F.col("at") + RUN - base).alias("around"))


def passages(docs: DataFrame, words: int) -> DataFrame:
    """The columns of fingerprints for each string of fewer than RUN lines that has so many words; around is the string itself."""
    long_enough = docs.where(F.length("text") >= 2 * words - 1)
    rows = long_enough.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("own"), F.filter(_lines(F.col("text")), _counts).alias("lines"))
    rows = _held(rows, hashes=F.transform("lines", lambda x: F.xxhash64(x)), sizes=F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\S+"))))

    def long(n: int) -> Column:
        enough = F.filter(_range(F.size("hashes") - (n - 1)), lambda i: sum((F.get("sizes", i + k) for k in range(1, n)), F.get("sizes", i)) >= words)
        return F.transform(enough, lambda i: F.struct(i.alias("base"), F.slice("hashes", i + 1, n).alias("around")))

    rows = rows.select("id", "own", F.explode(F.concat(*map(long, range(1, RUN)))).alias("s"))
    return rows.select("id", "own", F.xxhash64("s.around").alias("print"), "s.base", "s.around")


def _place(id: Column, own: Column, at: Column) -> Column:
    """The order of strings as one number, whose least a hash aggregate can take: by id, null ones last, 65 bits; by the upper 31
    bits of own, in which documents of one id differ; by the line, 31 bits."""
    last = F.lit(Decimal(2**64))
    number = F.coalesce((id.cast("decimal(20,0)") + F.lit(Decimal(2**63))).cast("decimal(20,0)"), last)
    rest = F.shiftrightunsigned(own, 33) * F.lit(2**31).cast("long") + at.cast("long")
    return number * F.lit(Decimal(2**62)) + rest.cast("decimal(19,0)")


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], value: str, spread: list[str]) -> DataFrame:
    """rows that have their `on` in table (on, n: how many rows have it, value), with value.

    Where one key has more than an equal part of HOT of all rows, of which there can be HOT at most, its row is broadcast, and its
    rows are dealt by `spread` in the join of the others, so no key is a task of its own."""
    many = F.col("n") > F.lit((table.agg(F.sum("n")).first()[0] or 0) / HOT)
    hot = table.where(many).select(*on, F.col(value).alias("__hot"))
    calm = table.where(~many).select(F.col(on[0]).alias("__look"), *on[1:], F.col(value).alias("__calm"))
    found = rows.join(F.broadcast(hot), on, "left")
    found = found.withColumn("__look", F.when(F.col("__hot").isNull(), F.col(on[0])).otherwise(F.xxhash64(*spread)))
    found = found.join(calm, ["__look", *on[1:]], "left").withColumn(value, F.coalesce("__hot", "__calm"))
    return found.where(F.col(value).isNotNull()).drop("__look", "__hot", "__calm")


def later_runs(docs: DataFrame, room: Scratch, words: int | None = None) -> DataFrame:
    """id, own, at and n: the first line (among those that count) and the lines of each string of RUN lines, or of fewer with so many words, that starts earlier elsewhere."""
    found = fingerprints(docs)
    if words is not None:
        found = found.unionByName(passages(docs, words))
    again = room.keep(found.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("times", F.col("n")), "prints")
    held = looked_up(found, again, ["print"], "times", ["id", "own", "base"])
    size = F.least(F.size("around"), F.lit(RUN))
    strings = F.transform(_range(F.size("around") - (size - 1)), lambda i: F.struct((F.col("base") + i).alias("at"), F.slice("around", i + 1, size).alias("lines")))
    each = held.select("id", "own", F.explode(strings).alias("s")).select("id", "own", "s.at", "s.lines")
    each = room.keep(each.select("*", F.xxhash64("lines").alias("key"), _place(F.col("id"), F.col("own"), F.col("at")).alias("place")), "strings")
    first = each.groupBy("key", "lines").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))
    first = room.keep(first.where("first < last").drop("last"), "firsts")
    later = looked_up(each, first, ["key", "lines"], "first", ["id", "own", "at"]).where("place > first")
    return later.select("id", "own", "at", F.size("lines").alias("n"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, words: int | None = None) -> DataFrame:
    """docs with column text without the lines that go, and removed, how many these are (int). Without words, only strings of
    RUN lines count; with it, so do strings of fewer lines that have so many words.

    A null text stays null. Rows of a repeated doc_id are documents in the order of a hash of their texts, and rows of the
    same doc_id and text are one document: each gets its result. Null ids come last. Other columns stay as they are; where one is
    called removed, the result's name is the next free one of removed_1, removed_2 and so on."""
    room = Scratch(spark, "lines")
    runs = later_runs(docs.select("doc_id", "text"), room, words).groupBy("id", "own").agg(F.collect_set(F.struct("at", "n")).alias("starts"))
    id, own, starts, lines, counted, covered, gone, text, removed = (free(docs.columns, f"__{n}") for n in ("id", "own", "starts", "lines", "counted", "covered", "gone", "text", "removed"))
    joined = docs.join(runs.toDF(id, own, starts), F.col("doc_id").eqNullSafe(F.col(id)) & (F.xxhash64("text") == F.col(own)), "left")
    joined = _held(joined, **{lines: F.when(F.col(starts).isNotNull(), _lines(F.col("text")))})
    reach = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    joined = _held(joined, **{counted: _counted(F.col(lines)), covered: reach})
    joined = _held(joined, **{gone: F.transform(covered, lambda i: F.get(counted, i))})
    kept = F.transform(F.array_except(_range(F.size(lines)), F.col(gone)), lambda i: F.get(lines, i))
    same = F.col(starts).isNull()
    joined = _held(joined, **{text: F.when(same, F.col("text")).otherwise(F.array_join(kept, "\n")), removed: F.when(same, F.lit(0)).otherwise(F.size(gone))})
    return joined.select(*(F.col(text).alias(c) if c == "text" else named(c) for c in docs.columns), F.col(removed).alias(free(docs.columns, "removed")))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeated_lines(spark, docs, PASSAGE)
    return found.select("doc_id", F.col("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op5_lines": op5_lines}

#: All strings of three lines and of one or two with 50 words, not only those at fingerprints, and lines themselves instead of hashes.
ORACLES = {
    "op5_lines": r"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (select doc_id, i, lines[i] as line, translate(lines[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12), '') <> '' as counts,
                len(regexp_extract_all(lines[i], '[^ \t\r\x0b\x0c]+')) as words
         from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from split)),
own as (select doc_id, i, line, words, row_number() over (partition by doc_id order by i) as j from line where counts),
next as (select doc_id, j, line as a, words, lead(line, 1) over w as b, lead(words, 1) over w as more, lead(line, 2) over w as c
         from own window w as (partition by doc_id order by j)),
string as (select doc_id, j, 1 as n, a, null as b, null as c from next where words >= 50
           union all select doc_id, j, 2, a, b, null from next where b is not null and words + more >= 50
           union all select doc_id, j, 3, a, b, c from next where c is not null),
later as (select doc_id, j, n from (select *, row_number() over (partition by n, a, b, c order by doc_id, j) as k from string) where k > 1),
gone as (select distinct doc_id, j + k as j from (select doc_id, j, unnest(range(n)) as k from later)),
marked as (select line.doc_id, line.i, line.line, gone.j is not null as gone
           from line left join own on own.doc_id = line.doc_id and own.i = line.i left join gone on gone.doc_id = own.doc_id and gone.j = own.j)
select doc_id, count(*) filter (gone) as n_removed, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id"""
}
