"""Best-fit packing of documents into bins of equal capacity, with conflicts.

A bin never holds two documents of one source or of one cluster of duplicates. Bins are ordered by what is left in them
and carry a bitmap of their sources and one of their clusters; an item goes to the tightest bin that is compatible, found
by a successor search that goes on from one residual to the next, or opens a bin. Items come in falling size.

Packing is sequential, so documents are dealt into shards of about SHARD by a hash: a shard holds a fair share of any hot
source or cluster, and bins that a shard leaves unfilled weigh less the larger it is. Documents of the same id, source, length
and cluster are one row with a count, dealt in lots of a LOTS-th of a shard, so that they don't meet in one shard however many they are.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.minhash import near_duplicates

#: Words of a bin, and documents of a shard.
CAPACITY, SHARD = 2048, 4096
#: Lots of a shard, and lots that are written out at once.
LOTS, LOTS_AT_ONCE = 64, 1024

PLACED = "doc_id long, piece int, start long, n_words long, bin_id long, slot int"


class Bins:
    """Open bins of one shard. At each residual the bits that all of its bins have tell at once that none will do."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.residuals: list[int] = []
        self.at: dict[int, list[int]] = {}
        self.common: dict[int, tuple[int, int]] = {}
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.filled: list[int] = []

    def _put(self, number: int, residual: int) -> None:
        sources, clusters = self.sources[number], self.clusters[number]
        if residual in self.at:
            insort(self.at[residual], number)
            a, b = self.common[residual]
            self.common[residual] = (a & sources, b & clusters)
        else:
            insort(self.residuals, residual)
            self.at[residual] = [number]
            self.common[residual] = (sources, clusters)

    def _take(self, number: int, residual: int) -> None:
        own = self.at[residual]
        own.pop(bisect_left(own, number))
        if not own:
            del self.at[residual], self.common[residual]
            self.residuals.pop(bisect_left(self.residuals, residual))

    def successor(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """The number and residual of the tightest compatible bin, the oldest of equals."""
        for i in range(bisect_left(self.residuals, size), len(self.residuals)):
            residual = self.residuals[i]
            a, b = self.common[residual]
            if a & source or b & cluster:
                continue
            for number in self.at[residual]:
                if not self.sources[number] & source and not self.clusters[number] & cluster:
                    return number, residual
        return None

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and slot of an item of 1 to capacity words; source and cluster are bits, 0 for none."""
        found = self.successor(size, source, cluster)
        if found is None:
            number, residual = len(self.filled), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
            self.filled.append(0)
        else:
            number, residual = found
            self._take(number, residual)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        self.filled[number] += 1
        if residual > size:
            self._put(number, residual - size)
        return number, self.filled[number] - 1


def pack_items(items: list[tuple[int, object, object]], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Bin and slot of each item (size, source, cluster), which come in falling size; None is no source or cluster."""
    bins, bits = Bins(capacity), ({None: 0}, {None: 0})

    def bit(kind: int, value: object) -> int:
        own = bits[kind]
        if value not in own:
            own[value] = 1 << (len(own) - 1)
        return own[value]

    return [bins.add(size, bit(0, source), bit(1, cluster)) for size, source, cluster in items]


def document_key(doc_id: Column, text: Column) -> Column:
    """The number of a document: its doc_id, or below zero by a hash of its text where that is null."""
    return F.coalesce(doc_id.cast("long"), F.bitwise_not(F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1)))


def dealt(alike: DataFrame, shard: int, n_shards: int) -> DataFrame:
    """alike (key, source, n, cluster, copies, ...) with a row for each lot of a LOTS-th of a shard, its copies and its shard."""
    lot = max(1, shard // LOTS)
    last = F.floor((F.col("copies") - 1) / lot)
    near = F.col("__far") * LOTS_AT_ONCE
    rows = alike.withColumn("__far", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / LOTS_AT_ONCE))))
    rows = rows.withColumn("__lot", F.explode(F.sequence(near, F.least(near + LOTS_AT_ONCE - 1, last))))
    to = F.pmod(F.xxhash64("key", "source", "n", "cluster", "__lot"), F.lit(n_shards)).cast("long")
    return rows.withColumn("shard", to).withColumn("copies", F.least(F.lit(lot).cast("long"), F.col("copies") - F.col("__lot") * lot)).drop("__far", "__lot")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, cluster: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """PLACED: the pieces of each document and their bins. docs has doc_id, text and source; cluster names a column of
    duplicates' clusters, or groups is a table (doc_id, cluster) of them; without either, documents of the same words in
    lower case are a cluster. Documents of no row of groups are in no cluster; of several rows of a doc_id the least cluster holds, and
    groups has documents without a doc_id by their document_key.

    A text longer than capacity is cut into pieces of capacity words, each a bin of its own, and a rest; start is a piece's
    first word. A text without words has one piece of none and a null bin. A null source or cluster conflicts with nothing;
    rows of a repeated doc_id are packed each on their own. Other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"\S+")).cast("long")
    same = F.col(cluster).cast("string") if cluster else F.md5(F.lower(F.regexp_replace(text, r"\s+", " ")).cast("binary"))
    n_shards = max(1, -(-docs.count() // shard))
    key = document_key(F.col("doc_id"), text) if groups is not None else F.col("doc_id").cast("long")
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("source").cast("string").alias("source"), words.alias("n"), same.alias("cluster"))
    told = [c for c in items.columns if groups is None or c != "cluster"]
    alike = items.groupBy(*told).agg(F.count(F.lit(1)).alias("copies"))
    if groups is not None:
        own = groups.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.min(F.col("cluster").cast("string")).alias("cluster"))
        alike = alike.join(own, "key", "left")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        out: list[tuple] = []
        rests = []
        used = 0
        lots = zip(*(rows.column(c).to_pylist() for c in ("doc_id", "source", "n", "cluster", "copies")), strict=True)
        for doc_id, source, n, same in (lot[:4] for lot in lots for _ in range(lot[4])):
            full = n // capacity
            for piece in range(full):
                out.append((doc_id, piece, piece * capacity, capacity, (number << 32) + used, 0))
                used += 1
            if n % capacity:
                rests.append((n % capacity, doc_id, full, source, same))
            elif not n:
                out.append((doc_id, 0, 0, 0, None, None))
        rests.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[3] is None, r[3] or "", r[4] is None, r[4] or ""))
        for (size, doc_id, piece, _, _), (at, slot) in zip(rests, pack_items([(r[0], r[3], r[4]) for r in rests], capacity), strict=True):
            out.append((doc_id, piece, piece * capacity, size, (number << 32) + used + at, slot))
        names = [x.split() for x in PLACED.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32()}
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(names, columns, strict=True)})

    return dealt(alike, shard, n_shards).groupBy("shard").applyInArrow(run, PLACED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates are the clusters, those among documents without an id too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    keyed = docs.select(document_key(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")
    return pack_documents(docs, groups=near_duplicates(spark, keyed).select("doc_id", F.col("component_id").alias("cluster")))


QUERIES = {"op7_packing": op7_packing}
