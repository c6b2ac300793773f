"""Prefix trie of conversations: which beginnings conversations share, and what sharing them saves.

A node is a distinct sequence of first turns, the root the sequence of none. Its members are the conversations that
begin with it. Turns are (role, text); they are compared by the SHA-256 of both.

1. Each conversation becomes a path: an array of turn digests with the turns' lengths. Equal paths are counted at once, so copies
   of a conversation are one row from here on.
2. Distinct paths are sorted and dealt into shards by range, so a first turn that a third of all conversations share is spread over
   many shards, too. A shard knows the last path before it and the first path after it.
3. Every shard encodes its trie as balanced parentheses in path order. The excess (open minus closed) is kept with the minima
   of blocks and of blocks of blocks; ``close`` finds the parenthesis that ends a subtree through them. The number
   of "()" up to a place counts leaves, running sums in node order give members and savings, each as a difference of
   two ranks.
4. The spine of nodes that neighbouring shards share comes out of each of them in part; the parts are added up by
   the digest of the node's path. A node counts as opened in the first shard that has it only, and a path that
   the next shard goes on with is no leaf.

Defined results: turns are ordered by number (null first), then digest. A null role or text is empty. Repeated rows are turns of their own.
Rows without a conversation id belong to none and are left out. Conversations without turns are members of the root. An empty
table gives no rows. Other columns take no part, whatever their names.
A conversation's digests (about 40 bytes a turn) are one array; texts are never gathered. SHA-256 reads a node's ids one after another, so
``ends_sha256`` streams the ids of one node through one task, in blocks, without holding them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.operators.ordered import neighbours
from trackflow.operators.tables import attach, materialise

SHARD_NODES = 50_000
ID_BLOCK = 4096  # conversation ids that may share a block of ``ends_sha256``
NODE = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_digest(role: Column, text: Column) -> Column:
    """The SHA-256 (hex) of a turn; the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def paths(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, path): each conversation's turns in order as array<struct<digest binary, size bigint>>."""
    role_, text_ = (F.col(f"`{c}`").cast("string") for c in (role, text))
    told = turns.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.unhex(turn_digest(role_, text_)).alias("digest"),
            F.length(F.coalesce(text_, F.lit(""))).cast("long").alias("size"),
        ).alias("t"),
    )
    listed = told.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _turn_order).alias("ts"))
    return listed.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"], t["size"])).alias("path"))


def _turn_order(a: Column, b: Column) -> Column:
    """By turn, null first, then digest."""
    both = F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1)
    one = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(both, one, F.when(a["digest"] < b["digest"], -1).when(a["digest"] > b["digest"], 1).otherwise(0))


class Parentheses:
    """Balanced parentheses (1 opens, 0 closes) with excess minima over blocks."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        padded = np.full(-(-len(bits) // self.BLOCK) * self.BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.minima = [padded.reshape(-1, self.BLOCK).min(axis=1)]
        while len(self.minima[-1]) > 1:
            below = self.minima[-1]
            if len(below) % 2:
                below = np.append(below, np.iinfo(np.int64).max)
            self.minima.append(below.reshape(-1, 2).min(axis=1))
        pair = np.zeros(len(bits) + 1, np.int64)
        pair[1:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.leaves = np.cumsum(pair)  # leaves[i]: "()" that begin before place i

    def _in_block(self, start: int, target: int) -> int:
        end = (start // self.BLOCK + 1) * self.BLOCK
        hit = np.flatnonzero(self.excess[start:end] == target)
        return start + int(hit[0]) if len(hit) else -1

    def close(self, place: int) -> int:
        """The place of the parenthesis that closes the one opened at ``place``."""
        target = int(self.excess[place]) - 1
        if (place + 1) % self.BLOCK:
            hit = self._in_block(place + 1, target)
            if hit >= 0:
                return hit
        level, block = 0, place // self.BLOCK + 1
        while self.minima[level][block] > target:
            block += 1
            while block % 2 == 0 and level + 1 < len(self.minima):
                level, block = level + 1, block // 2
        while level:
            level, block = level - 1, 2 * block
            if self.minima[level][block] > target:
                block += 1
        return self._in_block(block * self.BLOCK, target)

    def opens(self) -> np.ndarray:
        return np.flatnonzero(self.bits == 1)


def common(a: list[bytes], b: list[bytes]) -> int:
    """How many first digests two paths share."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def keys(path: list[bytes], depth: int) -> list[bytes]:
    """The digests of the nodes of depth 0 to ``depth`` on a path; none if ``depth`` is negative."""
    if depth < 0:
        return []
    running = hashlib.sha256()
    made = [running.digest()]
    for digest in path[:depth]:
        running.update(digest)
        made.append(running.digest())
    return made


def shard_nodes(rows: list[tuple], before: list[bytes] | None, after: list[bytes] | None) -> list[tuple]:
    """The nodes of one shard. ``rows``: (digests, sizes, conversations, smallest conv_id, ends) of distinct paths in order.

    Nodes that other shards have, too, get their key, and their numbers are this shard's part; children of such nodes get the parent's key.
    """
    bits, parent, depth, size, members, low, ends, stack = [], [], [], [], [], [], [], []
    last: list[bytes] = []
    first_path: list[int] = []
    for digests, sizes, n, smallest, digest in rows:
        keep = common(last, digests) + 1 if stack else 0
        bits += [0] * (len(stack) - keep)
        del stack[keep:]
        for d in range(keep, len(digests) + 1):
            parent.append(stack[-1] if stack else -1)
            stack.append(len(depth))
            bits.append(1)
            depth.append(d)
            size.append(sizes[d - 1] if d else 0)
            members.append(0)
            low.append(smallest)
            ends.append(None)
        members[stack[-1]], ends[stack[-1]] = n, digest
        low[stack[-1]] = min(low[stack[-1]], smallest)
        first_path = first_path or list(stack)
        last = digests
    last_path = list(stack)
    bits += [0] * len(stack)

    encoded = Parentheses(np.array(bits, np.uint8))
    opens = encoded.opens()
    closes = np.array([encoded.close(int(i)) for i in opens])
    node = np.arange(len(opens))
    end = node + (closes - opens + 1) // 2
    upto = lambda values: np.concatenate([[0], np.cumsum(values)])
    within = lambda sums: sums[end] - sums[node]

    from_before = -1 if before is None else common(before, rows[0][0])
    to_after = -1 if after is None else common(last, after)
    opened = np.ones(len(node), np.int64)
    opened[first_path[: from_before + 1]] = 0
    leaves = encoded.leaves[closes] - encoded.leaves[opens]
    if after is not None and to_after == len(last):
        leaves[last_path] -= 1
    n_convs = within(upto(members))
    sizes = np.array(size, np.int64)
    saved = within(upto(n_convs * sizes)) - within(upto(opened * sizes))
    above = np.array(parent)
    children = np.bincount(above[1:], weights=opened[1:], minlength=len(node)).astype(np.int64)
    for v in range(len(node) - 1, 0, -1):
        if low[v] < low[parent[v]]:
            low[parent[v]] = low[v]
    key: dict[int, bytes] = dict(zip(first_path, keys(rows[0][0], from_before)))
    key |= dict(zip(last_path, keys(last, to_after)))
    return [
        (key.get(v), key.get(p), low[v], depth[v], None if p < 0 or p in key else low[p], c, ch, lv, s, ends[v])
        for v, p, c, ch, lv, s in zip(range(len(node)), parent, n_convs.tolist(), children.tolist(), leaves.tolist(), saved.tolist())
    ]


def _shard(paths_: pa.Table, edges: pa.Table) -> pa.Table:
    rows = [([t["digest"] for t in r["path"]], [t["size"] for t in r["path"]], r["n"], r["low"], r["ends"]) for r in paths_.to_pylist()]
    rows.sort(key=lambda r: r[0])
    edge = edges.to_pylist()[0]
    before, after = (None if edge[c] is None else [t["digest"] for t in edge[c]] for c in ("before", "after"))
    columns = list(zip(*shard_nodes(rows, before, after)))
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    names = [part.split()[0] for part in NODE.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path_id, ends_sha256) of blocks of ids that come sorted by path_id and block."""
    now, running = None, hashlib.sha256()
    for batch in batches:
        done = []
        for path_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if path_id == now:
                running.update(b",")
            else:
                if now is not None:
                    done.append((now, running.hexdigest()))
                now, running = path_id, hashlib.sha256()
            running.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["path_id", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], ["path_id", "ends"])


def ends_digests(told: DataFrame) -> DataFrame:
    """(path_id, ends): the SHA-256 of each path's conversation ids, ascending and comma-joined. ``told``: (conv_id, path_id)."""
    block = F.floor(F.col("conv_id") / ID_BLOCK).alias("block")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    blocks = told.groupBy("path_id", block).agg(ids)
    ordered = blocks.repartition("path_id").sortWithinPartitions("path_id", "block")
    return ordered.select("path_id", "ids").mapInArrow(_ends, "path_id string, ends string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id, path), as ``paths`` makes them.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): smallest member, depth, the
    parent's smallest member, members, children, childless nodes below (or the node itself), what the subtree saves in code
    points if each node's last text is kept once, and the digest of the members that end here.
    """
    whole = F.sha2(F.array_join(F.transform("path", lambda t: F.hex(t["digest"])), ""), 256)
    told = materialise(conversations.select("conv_id", "path", whole.alias("path_id")))
    distinct = told.groupBy("path_id", "path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    distinct = materialise(distinct.join(ends_digests(told.select("conv_id", "path_id")), "path_id").drop("path_id"))
    nodes = distinct.agg(F.sum(F.size("path") + 1)).head()[0] or 0
    dealt = distinct.repartitionByRange(max(1, -(-nodes // SHARD_NODES)), "path")
    sharded = materialise(dealt.withColumn("shard", F.spark_partition_id()))
    edges = materialise(sharded.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")))
    beside = neighbours(edges, [], ["shard"], {"before": ("last", -1), "after": ("first", 1)}, F.floor(F.col("shard") / 4096))
    met = sharded.groupBy("shard").cogroup(beside.select("shard", "before", "after").groupBy("shard"))
    found = materialise(met.applyInArrow(_shard, NODE))
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spine = found.filter("key is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *total, F.max("ends_sha256").alias("ends_sha256")
    )
    spine = materialise(spine)
    every = found.filter("key is null").unionByName(spine.withColumn("parent_conv_id", F.lit(None).cast("long")))
    under = attach(every.filter("parent_key is not null"), spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_low")), ["parent_key"])
    under = under.withColumn("parent_conv_id", F.col("_low")).drop("_low")
    rows = every.filter("parent_key is null").unionByName(under)
    none = F.sha2(F.lit(""), 256)
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
