"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The features are rates and distances of a whole text: densities of a lexicon, how near its words stand to a second
person, capitals, punctuation and obfuscation. The lexicon is learned too: words that are far commoner in toxic labelled
texts than in others, those that tell most first. Fitting uses at most MAX_TRAIN labelled rows, those with the smallest hash of their id, so the
driver's share is the same at every size of the corpus; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.columns import free

#: Most labelled rows that a model is fitted on.
MAX_TRAIN = 20_000
#: Most words of a lexicon; the fewest toxic texts of a word in it, and their share of all toxic ones; least log-odds, and those of a strong word.
LEXICON, LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS, STRONG = 400, 5, 0.005, 2.0, 4.0
#: Words between a lexicon word and a second person that count as near.
NEAR = 5
#: Letters of a word's beginnings that count besides the word.
STEMS = (5, 4)
#: Tokens whose features a worker keeps, and the most characters of one; characters of a text that are looked at in one piece.
KEPT, KEPT_LENGTH, PIECE = 200_000, 64, 1 << 18

#: Second-person words of the corpus's languages.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
#: Characters that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "!": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g"})

EDGE = "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»„“”‘’¡¿…"
PER_TOKEN = ("weight", "lexicon", "strong", "hidden", "second", "letters", "upper", "all_caps", "mixed", "stretched", "single", "exclaim", "question", "stars", "marks")
FEATURES = (
    "log_words", "weight_rate", "weight_sum", "lexicon_rate", "lexicon_count", "strong_rate", "strong_count", "strong_kinds", "hidden_rate", "hidden_count", "spaced_count",
    "second_rate", "near_count", "near_rate", "nearest", "upper_rate", "all_caps_rate", "mixed_rate", "stretched_rate", "single_rate",
    "exclaim_rate", "question_rate", "star_rate", "mark_rate", "mean_word", "max_weight",
)


_BLANK = re.compile(r"\s")
_STRETCHED, _TRIPLE, _MARKS = re.compile(r"(.)\1\1"), re.compile(r"(.)\1{2,}"), re.compile(r"[\W_]")


def word(token: str) -> str:
    return token.strip(EDGE).lower()


def plain_letters(token: str) -> str:
    """token without what hides its letters: look-alikes, marks between and stretched letters."""
    return _TRIPLE.sub(r"\1", _MARKS.sub("", token.lower().translate(LEET)))


def forms(key: str) -> list[str]:
    """What a word can be in a lexicon as, closest first: itself, and its beginnings, as endings vary."""
    return [key, *(f"^{key[:n]}" for n in STEMS if len(key) > n)]


def pieces(text: str) -> Iterator[list[str]]:
    """The tokens of a text, some PIECE characters of it at a time; none of them is empty, and no token is cut."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        tokens = text[at:end].split()
        if tokens:
            yield tokens
        at = end


class Nearness:
    """Lexicon words that stand at most NEAR tokens from a second person, and 1 / (1 + the least distance), over pieces of a text."""

    def __init__(self) -> None:
        self.count, self.gap = 0, np.inf
        self.hits, self.told, self.persons = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def nearest(self) -> float:
        return 1.0 / (1.0 + self.gap)

    def add(self, hits: np.ndarray, persons: np.ndarray, end: int) -> None:
        """Places in the next piece. Of those before only the last person matters, the last hit, and hits that a person just ahead would be near to."""
        hits, told = np.concatenate([self.hits, hits]), np.concatenate([self.told, np.zeros(len(hits), bool)])
        persons = np.concatenate([self.persons, persons])
        if len(hits) and len(persons):
            j = np.searchsorted(persons, hits)
            gap = np.minimum(np.abs(hits - persons[np.maximum(j - 1, 0)]), np.abs(persons[np.minimum(j, len(persons) - 1)] - hits))
            self.count += int(((gap <= NEAR) & ~told).sum())
            self.gap = min(self.gap, int(gap.min()))
            told = told | (gap <= NEAR)
        late = hits >= end - NEAR
        late[-1:] = True
        self.hits, self.told, self.persons = hits[late], told[late], persons[-1:]


class Spaced:
    """Runs of single letters that spell a lexicon word, over pieces of a text. Of a run only its end is kept."""

    def __init__(self, words: list[str]) -> None:
        self.words, self.longest = words, max(map(len, words), default=1)
        self.found, self.tail, self.told = 0, "", False

    def add(self, single: np.ndarray, tokens: list[str]) -> None:
        flags = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
        ends = np.flatnonzero(flags == -1)
        for i, j in zip(np.flatnonzero(flags == 1), ends, strict=True):
            if i > 0:
                self.tail, self.told = "", False
            text = self.tail + "".join(word(t) for t in tokens[i:j])
            if not self.told and len(text) >= 3 and any(w in text for w in self.words):
                self.found, self.told = self.found + 1, True
            self.tail = text[-self.longest :]
        if not len(ends) or ends[-1] < len(tokens):
            self.tail, self.told = "", False


class Extractor:
    """Features of texts under one lexicon of word weights."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.words = [w for w in lexicon if len(w) >= 3 and w[0] != "^"]
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(PER_TOKEN)))

    def weigh(self, key: str) -> float:
        """The weight of a word's closest form that the lexicon has, else 0."""
        for form in forms(key):
            if form in self.lexicon:
                return self.lexicon[form]
        return 0.0

    def row(self, token: str) -> list[float]:
        core = token.strip(EDGE)
        key = core.lower()
        weight = self.weigh(key)
        second, single, edges = float(key in SECOND_PERSON), float(len(key) == 1), len(token) - len(core)
        stretched = _STRETCHED.search(key) is not None
        ends = (token.count("!"), token.count("?"), token.count("*")) if edges else (0, 0, 0)
        if not stretched and core.isalpha():  # what most tokens are: nothing in them hides letters
            letters, upper = len(core), 0 if core.islower() else sum(map(str.isupper, core))
            return [weight, float(weight > 0), float(weight >= STRONG), 0.0, second, letters, upper, float(upper == letters > 2), 0.0, 0.0, single, *ends, edges]
        hidden = 0.0 if weight else self.weigh(plain_letters(token))
        letters, upper = sum(map(str.isalpha, token)), sum(map(str.isupper, token))
        mixed = float(letters > 0 and any(not c.isalpha() and c not in "-'’" for c in key[1:-1]))
        return [
            weight or hidden, float(weight > 0), float((weight or hidden) >= STRONG), float(hidden > 0), second, letters, upper, float(upper == letters > 2), mixed, float(stretched), single,
            token.count("!"), token.count("?"), token.count("*"), sum(c in EDGE for c in token),
        ]

    def add(self, token: str) -> int:
        """The token's row of the table; one of over KEPT_LENGTH characters isn't kept for the next text."""
        if len(self.at) >= KEPT:
            self.at.clear()
        i = len(self.at)
        if i == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[i] = self.row(token)
        self.at[token if len(token) <= KEPT_LENGTH else i] = i
        return i

    def features(self, text: str | None) -> list[float]:
        """The FEATURES of a whole text, added up by pieces of it; zeros for null and for a text without words."""
        n, most, total = 0, 0.0, np.zeros(len(PER_TOKEN))
        kinds: set[int] = set()
        near, spaced = Nearness(), Spaced(self.words)
        for tokens in pieces(text or ""):
            if len(self.at) + len(tokens) > KEPT:
                self.at.clear()
            at = self.at
            where = [at[t] if t in at else self.add(t) for t in tokens]  # may grow the table
            each = self.table[where]
            total += each.sum(axis=0)
            most = max(most, each[:, 0].max())
            near.add(n + np.flatnonzero(each[:, 0] > 0), n + np.flatnonzero(each[:, 4] > 0), n + len(tokens))
            spaced.add(each[:, 10] > 0, tokens)
            kinds.update(hash(plain_letters(tokens[i])) for i in np.flatnonzero(each[:, 2] > 0))
            n += len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        sums = dict(zip(PER_TOKEN, total, strict=True))
        letters = max(1.0, sums["letters"])
        return [
            np.log1p(n), sums["weight"] / n, sums["weight"], sums["lexicon"] / n, sums["lexicon"], sums["strong"] / n, sums["strong"], len(kinds), sums["hidden"] / n, sums["hidden"], spaced.found,
            sums["second"] / n, near.count, near.count / n, near.nearest, sums["upper"] / letters, sums["all_caps"] / n, sums["mixed"] / n, sums["stretched"] / n, sums["single"] / n,
            sums["exclaim"] / n, sums["question"] / n, sums["stars"] / n, sums["marks"] / n, letters / n, most,
        ]


@dataclass
class Trees:
    """Boosted trees of equal depth as arrays: node i has children 2i+1 and 2i+2; the last level are leaves."""

    base: float
    depth: int
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (1 << self.depth) + 1]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 8) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    score, inner, leaves = np.full(n, base), (1 << depth) - 1, 1 << depth
    features, limits, values = [], [], []
    for _ in range(n_trees):
        p = _sigmoid(score)
        g, h = y - p, p * (1 - p)
        node, feature, limit = np.zeros(n, dtype=np.int64), np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            own, best = node - first, np.full(count, 1e-9)
            pick, cut = np.zeros(count, dtype=np.int64), np.full(count, -1)
            for j in range(width):
                cell = own * bins + binned[:, j]
                gs, hs, cs = (np.bincount(cell, w, count * bins).reshape(count, bins).cumsum(axis=1) for w in (g, h, None))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(cs < least) | (ct - cs < least)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                best[better], pick[better], cut[better] = gain[np.arange(count), top][better], j, top[better]
            for k in np.flatnonzero(cut >= 0):
                feature[first + k], limit[first + k] = pick[k], edges[pick[k]][cut[k]]
            node = 2 * node + 1 + ((binned[np.arange(n), pick[own]] > cut[own]) & (cut[own] >= 0))
        own = node - inner
        leaf = rate * np.bincount(own, g, leaves) / (np.bincount(own, h, leaves) + l2)
        score += leaf[own]
        features.append(feature)
        limits.append(limit)
        values.append(leaf)
    return Trees(base, depth, np.array(features), np.array(limits), np.array(values))


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the mean raw score and the smoothed share of label 1 of each pool, both increasing."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for r, t in zip(raw[order], y[order], strict=True):
        pools.append([t, 1.0, r])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    hits, n, at = np.array(pools).T
    return at / n, np.maximum.accumulate(np.clip((hits + 0.02) / (n + 0.04), 0.001, 0.999))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    at: np.ndarray
    share: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the uncalibrated score keeps the order within a pool."""
        if self.trees is None:
            return np.full(len(x), self.share[0])
        raw = self.trees.raw(x)
        return 0.999 * np.interp(raw, self.at, self.share) + 0.001 * _sigmoid(raw)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """At most `most` labelled ids that aren't held out: those with the smallest hash. Null ids and labels are left out; of several labels of an id the largest holds."""
    one = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and beginnings of words by their log-odds between toxic and other texts of rows (text, toxic), each text counting once for one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for tokens in pieces(text or "") for w in map(word, set(tokens)) if 2 < len(w) <= 40 and w not in SECOND_PERSON}
                seen[int(toxic > 0)].update({form for w in words for form in forms(w)})
                if len(seen[0]) + len(seen[1]) > KEPT:
                    yield told(seen)
                    seen[0].clear()
                    seen[1].clear()
        yield told(seen)

    def told(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        words = [*(seen[0].keys() | seen[1].keys())]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([side[w] for w in words], pa.int64()) for side in seen)], ["word", "clean", "toxic"])

    n = {int(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return {}
    sums = rows.select("text", "toxic").mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    t, c, n = F.col("toxic").cast("double"), F.col("clean").cast("double"), float(bad + good)
    odds = F.log((t + 0.5) / F.lit(bad + 1.0)) - F.log((c + 0.5) / F.lit(good + 1.0))
    # The likelihood ratio against a word that says nothing.
    told_by = t * F.log(t * n / ((t + c) * bad)) + F.when(c > 0, c * F.log(c * n / ((t + c) * good))).otherwise(0.0)
    enough = sums.where(F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * bad))
    top = enough.select("word", odds.alias("odds"), told_by.alias("told")).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("told"), "word").limit(LEXICON)
    return {r["word"]: float(r["odds"]) for r in top.collect()}


def _extract(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """Features of labelled rows, with their id and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Extractor(lexicon)
        for batch in batches:
            x = pa.array([tool.features(t.as_py()) for t in batch.column(3)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x], ["doc_id", "toxic", "apart", "x"])

    return rows.select(F.col("doc_id").cast("long"), "toxic", "apart", "text").mapInArrow(run, "doc_id long, toxic int, apart boolean, x array<double>")


def apart(id_col: str = "doc_id") -> F.Column:
    """Whether a labelled row is kept for the calibration, and so hidden from the lexicon and the trees."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """A model from labelled documents that aren't held out. Without texts of both labels it always gives the label's share.

    The lexicon and the trees learn from the rows that aren't apart, and the calibration from those that are, so its shares come
    from scores of labels that nothing before has seen. Where either side lacks a label, all three learn from all rows."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample(labels, most)), "doc_id").withColumn("apart", apart())  # at most `most` ids and labels
    sides = {(r["apart"], r["toxic"]) for r in rows.select("apart", "toxic").distinct().collect()}  # four at most
    split = len(sides) == 4
    lexicon = learn_lexicon(rows.where(~F.col("apart")) if split else rows)
    got = _extract(rows, lexicon).toPandas().sort_values(["doc_id", "toxic"])
    y = got["toxic"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return Model({}, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    x = np.array(got["x"].tolist())
    part = got["apart"].to_numpy(dtype=bool) if split else np.zeros(len(y), dtype=bool)
    trees = fit_trees(x[~part], y[~part])
    shown = part if split else ~part
    return Model(lexicon, trees, *fit_isotonic(trees.raw(x[shown]), y[shown]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxicity between 0 and 1, from the text alone; null and empty texts have the score of no words.

    Only texts go to Python workers. Other columns of any kind stay as they are; where one is called toxicity, the score's name
    is the next free one of toxicity_1, toxicity_2 and so on."""

    @F.pandas_udf("double")
    def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = Extractor(model.lexicon)
        for texts in parts:
            yield pd.Series(model.score(np.array([tool.features(t) for t in texts])) if len(texts) else [], dtype="float64")

    return docs.select("*", toxicity("text").alias(free(docs.columns, "toxicity")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
