"""A prefix trie of conversations, built of families first.

A conversation begins with turns of its family's first one, so conversations of a family share most of their nodes:

1. the turns of a family, as digests, are gathered by base id into one row; its conversations are rebuilt, and its own small
   trie is made, with a bit for each conversation that reaches a node and for each that ends there. A node's key is a digest of
   its parent's key and its turn, so families need nothing of each other;
2. only nodes of families are shuffled: by key their members are added up, and the smallest one is the node's conv_id. Nodes of
   one conv_id are a chain down its conversation, as whoever is smallest at a node is so at each next one of its own;
3. sums of subtrees need no walk from level to level: what a chain has is told to its family, which adds it to all nodes on
   the way down to it, chain by chain and conversation by conversation; these sums are again combined by family, then by key.

So rows grow with the turns, whatever the depth, and no node's members are gathered: ids of conversations that end at a node
are joined in blocks of IDS, and the blocks are digested one after another, as SHA-256 must.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import Any
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.lines import looked_up
from tesserae.llm.scratch import Scratch

#: Conversations of a family, and what a checksum is divided by for the turns taken from its first one.
FAMILY, TURNS = 5, 9
#: Conversation ids of a block that are joined into one string.
IDS = 1 << 14
#: Bytes of a key; that of the root.
KEY, ROOT = 16, b""
NODE = "struct<key: binary, up: int, depth: long, size: long, members: int, least: long, ending: array<long>>"
FAMILIES = f"base long, convs array<long>, nodes array<{NODE}>"
SUMS = "key binary, saved long, leaves long, children long, conv_id long, depth long, n_convs long, parent binary"


def shared_turns(conv_id: int) -> int:
    """Turns that a conversation takes from the first one of its family."""
    return crc32(b"%d" % conv_id) % TURNS


def gathered(turns: DataFrame) -> DataFrame:
    """base and turns, an array in order of conversation and turn, of turns (conv_id, turn, role, text); texts only as a digest and a size."""
    role, text = (F.coalesce(F.col(c), F.lit("")).cast("binary") for c in ("role", "text"))
    head = F.concat(F.octet_length(role).cast("string"), F.lit(":")).cast("binary")
    digest = F.substring(F.unhex(F.sha2(F.concat(head, role, text), 256)), 1, KEY)
    own = F.struct(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).cast("long")
    return turns.where("conv_id is not null").groupBy(base.alias("base")).agg(F.sort_array(F.collect_list(own)).alias("turns"))


def small_trie(base: int, convs: dict[int, list[tuple[bytes, int]]]) -> list[dict[str, Any]]:
    """The nodes of a family's conversations, rebuilt, parents first. convs has their own turns in ascending order of ids; bit i of members is the i-th one."""
    nodes: list[dict[str, Any]] = []
    places: dict[bytes, int] = {}

    def reached(key: bytes, up: int, depth: int, size: int, i: int, conv_id: int) -> int:
        if key not in places:
            places[key] = len(nodes)
            nodes.append({"key": key, "up": up, "depth": depth, "size": size, "members": 0, "least": conv_id, "ending": []})
        nodes[places[key]]["members"] |= 1 << i
        return places[key]

    first = convs.get(base, [])
    for i, (conv_id, own) in enumerate(convs.items()):
        taken, at = shared_turns(conv_id), reached(ROOT, -1, 0, 0, i, conv_id)
        for depth, (digest, size) in enumerate(first[:taken] + own[taken:], 1):
            at = reached(sha256(nodes[at]["key"] + digest).digest()[:KEY], at, depth, size, i, conv_id)
        nodes[at]["ending"].append(conv_id)
    return nodes


def families(turns: DataFrame) -> DataFrame:
    """FAMILIES of turns (conv_id, turn, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                convs: dict[int, list[tuple[bytes, int]]] = {}
                for t in own:
                    convs.setdefault(t["conv_id"], []).append((t["digest"], t["size"]))
                rows.append({"base": base, "convs": list(convs), "nodes": small_trie(base, convs)})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return gathered(turns).mapInArrow(run, FAMILIES)


_NODE = pa.struct([("key", pa.binary()), ("up", pa.int32()), ("depth", pa.int64()), ("size", pa.int64()), ("members", pa.int32()), ("least", pa.int64()), ("ending", pa.list_(pa.int64()))])
_SCHEMA = pa.schema([("base", pa.int64()), ("convs", pa.list_(pa.int64())), ("nodes", pa.list_(_NODE))])
_SUMS = pa.schema([(n, pa.binary() if kind == "binary" else pa.int64()) for n, kind in (c.split() for c in SUMS.split(", "))])


def merged(found: DataFrame) -> DataFrame:
    """key, conv_id (the smallest member), n_convs and n_ends of every node of all families."""
    each = found.select(F.inline("nodes")).select("key", "least", F.bit_count("members").alias("n"), F.size("ending").alias("e"))
    return each.groupBy("key").agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("e").alias("n_ends"))


def family_sums(convs: list[int], nodes: list[dict[str, Any]], owned: dict[bytes, dict[str, int]]) -> list[dict[str, Any]]:
    """A row of SUMS for each node of a family: what the chains of its conversations add to it; for owned ones, whose smallest member is of the family, with what they are."""
    rows: list[dict[str, Any]] = [dict.fromkeys(_SUMS.names) | {"key": v["key"], "saved": 0, "leaves": 0, "children": 0} for v in nodes]
    for i, conv_id in enumerate(convs):
        path = [k for k, v in enumerate(nodes) if v["members"] >> i & 1]  # parents first
        saved, leaf = 0, 0
        for k in reversed(path):
            own = owned.get(nodes[k]["key"])
            if own and own["conv_id"] == conv_id:
                leaf = leaf or int(own["n_convs"] == own["n_ends"])
                saved += (own["n_convs"] - 1) * nodes[k]["size"]
                up = nodes[k]["up"]
                rows[k] |= {"conv_id": conv_id, "depth": nodes[k]["depth"], "n_convs": own["n_convs"], "parent": nodes[up]["key"] if up >= 0 else None}
                if up >= 0:
                    rows[up]["children"] += 1
            rows[k]["saved"] += saved
            rows[k]["leaves"] += leaf
    return rows


def sums(found: DataFrame, every: DataFrame) -> DataFrame:
    """SUMS of families and of all nodes, which meet in the family of the smallest member."""
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    owned = every.groupBy(base).agg(F.collect_list(F.struct("key", "conv_id", "n_convs", "n_ends")).alias("owned"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for convs, nodes, own in zip(*(batch.column(c).to_pylist() for c in ("convs", "nodes", "owned")), strict=True):
                yield pa.RecordBatch.from_pylist(family_sums(convs, nodes, {x["key"]: x for x in own or []}), schema=_SUMS)

    return found.join(owned, "base", "left").select("convs", "nodes", "owned").mapInArrow(run, SUMS)


def endings(found: DataFrame) -> DataFrame:
    """key and ends_sha256 of the nodes where a conversation ends."""
    each = found.select(F.inline("nodes")).select("key", F.explode("ending").alias("conv_id"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = each.groupBy("key", F.floor(F.col("conv_id") / IDS).alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = own, sha256(ids.encode("ascii"))
                else:
                    state.update(b"," + ids.encode("ascii"))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    return blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, of turns (conv_id, turn, role, text): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (long) and ends_sha256.

    A conversation is the first turns of its family's first one (shared_turns; fewer if it has no more, none if it isn't there) and its
    own ones after so many. Null roles and texts are empty, null turns come first, equal numbers are in the order of a digest of role and
    text, and rows without a conv_id are left out; a table without conversations has no nodes. Other columns don't matter. A conversation
    is a row of digests, of some 60 bytes a turn, in one task with its family; very many ids that end at one node are digested one block
    after another in one task, which holds one block."""
    room = Scratch(turns.sparkSession, "trie")
    found = room.keep(families(turns), "families")
    each = room.keep(sums(found, merged(found)), "sums")
    total = [F.sum(c).alias(c) for c in ("saved", "leaves", "children")] + [F.max(c).alias(c) for c in ("conv_id", "depth", "n_convs")]
    nodes = room.keep(each.groupBy("key").agg(*total), "nodes")
    table = nodes.where("children > 0").select(F.xxhash64("key").alias("code"), F.col("key").alias("parent"), F.col("children").alias("n"), F.col("conv_id").alias("parent_conv_id"))
    below = each.where("parent is not null").select("key", F.xxhash64("parent").alias("code"), "parent")
    below = looked_up(below, table, ["code", "parent"], "parent_conv_id", ["key"])
    whole = nodes.join(below.select("key", "parent_conv_id"), "key", "left").join(endings(found), "key", "left")
    none = F.lit(sha256(b"").hexdigest())
    counts = (F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", *counts, F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op13_trie": op13_trie}

#: Nodes by the digests of their turns, one after another, and every node with all nodes whose digests begin with its own. The checksum
#: is the usual one with polynomial 0xEDB88320, bit by bit.
ORACLES = {
    "op13_trie": """
with own as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as i, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
id as (select c, c::varchar as s from (select distinct c from own)),
bits as (select c, list_transform(range(8 * length(s)), lambda k: case when k % 8 = 0 then ascii(substr(s, (k // 8 + 1)::int, 1)) else 0 end::bigint) as b from id),
head as (select c, c - c % 5 as base, xor(list_reduce(list_concat([4294967295::bigint], b), lambda x, y: xor(xor(x, y) >> 1, case when xor(x, y) & 1 = 1 then 3988292384 else 0 end)), 4294967295) % 9 as h from bits),
rebuilt as (select head.c, i, role, text from head join own on own.c = head.base where i <= h
            union all select head.c, i, role, text from head join own on own.c = head.c where i > h),
placed as (select c, row_number() over (partition by c order by i) as d, strlen(text) as size, sha256(role || chr(1) || text) as t from rebuilt),
prefix as (select c, d, size, string_agg(t, '') over (partition by c order by d) as p from placed union all select c, 0, 0, '' from id),
last as (select c, max(d) as d from prefix group by c),
node as (select p, prefix.d as d, min(c) as c, count(*) as n, any_value(size) as size, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (last.d = prefix.d), '')) as ends
         from prefix join last using (c) group by p, prefix.d),
child as (select substr(p, 1, 64 * (d - 1)::int) as p, count(*) as n_children from node where d > 0 group by 1),
each as (select node.*, coalesce(n_children, 0) as n_children from node left join child using (p)),
above as (select substr(p, 1, 64 * k::int) as p, (n - 1) * size as saved, n_children = 0 as leaf from (select *, unnest(range(d + 1)) as k from each)),
below as (select p, sum(saved)::bigint as saved_tokens, count(*) filter (leaf) as n_leaves from above group by p)
select each.c as conv_id, each.d as depth, up.c as parent_conv_id, each.n as n_convs, each.n_children, n_leaves, saved_tokens, each.ends as ends_sha256
from each join below using (p) left join node up on up.d = each.d - 1 and up.p = substr(each.p, 1, 64 * up.d::int)"""
}
