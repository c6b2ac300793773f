"""Reversible line dedup: exact reference counts of lines, with cuckoo filters per shard.

A line's key is the line without white space (space, \\t to \\r) at both ends, with
A-Z lower-cased; keys travel as 128-bit hashes. The reference-count table holds
for every key how many documents have it. Documents are added with ``insert`` and taken out
with ``delete``: both only add signed counts, so a deletion undoes an insertion exactly.

Keys that enough documents share are "common". Each shard of the key space has a cuckoo
filter over its common keys. The filters follow the counts: keys that become
common are inserted, keys that cease to be common are deleted. Dropping lines asks the
filter first; only lines it lets pass are looked up in the exact table.

Defined results: a null or empty text is one empty line; an empty key is never common. Rows of one doc_id are
one document: all rows are inserted, then the references that they hold more than once are deleted again. A row
without doc_id is a document of its own. Every row gets its result from its own text. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.llm.frames import shuffle_parts, utf8
from trackflow.operators.tables import attach, materialise, row_count

WHITE = b" \t\n\x0b\x0c\r"
SLOTS = 4
KICKS = 500
KEYS_PER_SHARD = 200_000
ROWS_PER_PROBE = 400_000


class CuckooFilter:
    """A set of 128-bit keys with insertion, deletion and rare false positives.

    16-bit fingerprints in buckets of four; a key's two buckets differ by a
    hash of its fingerprint. An insertion that finds no place raises OverflowError, and
    the caller builds a filter of twice the size from the exact table.
    """

    def __init__(self, buckets: int, table: bytes | None = None):
        self.buckets = buckets  # a power of two
        if table is None:
            self.table = np.zeros((buckets, SLOTS), np.uint16)
        else:
            self.table = np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy()

    @classmethod
    def for_keys(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(2, math.ceil(math.log2(max(1, len(h1)) / SLOTS / 0.8)))
        while True:
            made = cls(buckets)
            try:
                for a, b in zip(h1.tolist(), h2.tolist()):
                    made.insert(a, b)
                return made
            except OverflowError:
                buckets *= 2

    @staticmethod
    def _jump(mark: int) -> int:
        return (mark * 0x5BD1E995) & 0xFFFFFFFF

    def _places(self, h1: int, h2: int) -> tuple[int, int, int]:
        mark = (h2 & 0xFFFF) or 1
        one = (h2 >> 16) & (self.buckets - 1)
        return mark, one, (one ^ self._jump(mark)) & (self.buckets - 1)

    def insert(self, h1: int, h2: int) -> None:
        mark, one, two = self._places(h1, h2)
        for place in (one, two):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        place = one
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = (place ^ self._jump(mark)) & (self.buckets - 1)
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        raise OverflowError("no place left")

    def delete(self, h1: int, h2: int) -> None:
        """Takes out a key that was inserted."""
        mark, one, two = self._places(h1, h2)
        for place in (one, two):
            held = np.flatnonzero(self.table[place] == mark)
            if len(held):
                self.table[place, held[0]] = 0
                return

    def may_hold(self, h2: np.ndarray) -> np.ndarray:
        h2 = h2.astype(np.int64)
        mark = h2 & 0xFFFF
        mark[mark == 0] = 1
        one = (h2 >> 16) & (self.buckets - 1)
        two = (one ^ ((mark * 0x5BD1E995) & 0xFFFFFFFF)) & (self.buckets - 1)
        found = (self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])
        return found.any(axis=1)


def _key_hash(line: bytes) -> tuple[int, int] | None:
    key = line.strip(WHITE)
    if not key:
        return None
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, one, two = [], [], []
        for i, text in enumerate(utf8(batch.column(1))):
            keys = {_key_hash(line) for line in text.lower().split(b"\n")}
            keys.discard(None)
            rows += [i] * len(keys)
            one += [k[0] for k in keys]
            two += [k[1] for k in keys]
        ids = batch.column(0).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["doc_id", "h1", "h2"])


def line_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h1, h2): the distinct line keys of every row, empty ones left out."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _pairs, "doc_id long, h1 long, h2 long"
    )


def reference_counts(keys: DataFrame) -> DataFrame:
    """(h1, h2, n): in how many documents every key is."""
    return keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))


def insert(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """The counts with more documents."""
    return _changed(counts, reference_counts(keys), 1)


def delete(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """The counts without documents that were inserted; keys that no document has are gone."""
    return _changed(counts, reference_counts(keys), -1)


def surplus(keys: DataFrame) -> DataFrame:
    """(h1, h2, n): how many references of a key come from further rows of a doc_id that has it already."""
    rows = keys.filter("doc_id IS NOT NULL").groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return rows.filter("n > 1").groupBy("h1", "h2").agg(F.sum(F.col("n") - 1).alias("n"))


def _changed(counts: DataFrame, references: DataFrame, sign: int) -> DataFrame:
    change = references.withColumn("n", F.col("n") * sign)
    return counts.unionByName(change).groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 0")


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def build_filters(common: DataFrame, shards: int) -> DataFrame:
    """(shard, buckets, cells): a filter for each shard that has common keys.

    A shard holds KEYS_PER_SHARD keys or so, whatever the size of the table; keys are
    distinct, so no shard is hot.
    """

    def build(table: pa.Table) -> pa.Table:
        made = CuckooFilter.for_keys(table["h1"].to_numpy(), table["h2"].to_numpy())
        return pa.table({"shard": table["shard"][:1], "buckets": [made.buckets], "cells": [made.table.tobytes()]})

    sharded = common.select(_shard(shards).alias("shard"), "h1", "h2")
    return sharded.groupBy("shard").applyInArrow(build, "shard int, buckets long, cells binary")


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """Filters that follow the counts: deletes and inserts only keys that ceased to be or became common.

    ``before`` and ``after`` are reference counts. A filter that is full is built anew from the exact table.
    """
    was = before.filter(F.col("n") >= min_docs).select("h1", "h2", F.lit(-1).alias("way"))
    now = after.filter(F.col("n") >= min_docs).select("h1", "h2", F.lit(1).alias("way"))
    moved = was.unionByName(now).groupBy("h1", "h2").agg(F.min("way").alias("low"), F.max("way").alias("high"))
    moved = moved.select(_shard(shards).alias("shard"), "h1", "h2", "low", "high")

    def change(old: pa.Table, keys: pa.Table) -> pa.Table:
        shard = (old if old.num_rows else keys)["shard"][0].as_py()
        rows = list(zip(*[keys[c].to_pylist() for c in ("h1", "h2", "low", "high")]))
        try:
            made = CuckooFilter(old["buckets"][0].as_py(), old["cells"][0].as_py()) if old.num_rows else CuckooFilter(4)
            for a, b, low, high in rows:
                if high < 0:
                    made.delete(a, b)
            for a, b, low, high in rows:
                if low > 0:
                    made.insert(a, b)
        except OverflowError:
            kept = [(a, b) for a, b, _, high in rows if high > 0]
            one, two = (np.array([k[i] for k in kept], np.int64) for i in (0, 1))
            made = CuckooFilter.for_keys(one, two)
        return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": [made.buckets], "cells": [made.table.tobytes()]})

    return filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(change, "shard int, buckets long, cells binary")


def shard_count(common: DataFrame) -> int:
    return max(1, math.ceil(row_count(common) / KEYS_PER_SHARD))


def follow(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_docs: int) -> tuple[DataFrame, int]:
    """The filters after a change of the counts, written, and their number of shards.

    Shards that have grown to twice KEYS_PER_SHARD are dealt anew, from the exact table.
    """
    common = materialise(after.filter(F.col("n") >= min_docs))
    wanted = shard_count(common)
    if wanted > 2 * shards:
        return materialise(build_filters(common, wanted)), wanted
    return materialise(update_filters(filters, before, after, shards, min_docs)), shards


def common_lines(keys: DataFrame, common: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows of ``keys`` (written) whose key is in ``common``: the filter first, then the exact table.

    A shard's rows are dealt over as many parts as keep one part to ROWS_PER_PROBE rows, also if every document
    had the same line; its filter goes to these parts only.
    """
    by = keys.select("doc_id", "h1", "h2", _shard(shards).alias("shard"))
    parts = F.ceil(F.count(F.lit(1)) / ROWS_PER_PROBE).cast("int").alias("parts")
    dealt = materialise(by.groupBy("shard").agg(parts))
    by = attach(by, dealt, ["shard"], "inner")
    by = by.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int")).drop("parts")
    spread = filters.join(dealt, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def probe(lines: pa.Table, held: pa.Table) -> pa.Table:
        lines = lines.select(["doc_id", "h1", "h2"])
        if not held.num_rows or not lines.num_rows:
            return lines.slice(0, 0)
        mine = CuckooFilter(held["buckets"][0].as_py(), held["cells"][0].as_py())
        return lines.filter(pa.array(mine.may_hold(lines["h2"].to_numpy())))

    grouped = by.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part"))
    passed = grouped.applyInArrow(probe, "doc_id long, h1 long, h2 long")
    return passed.join(common.select("h1", "h2"), ["h1", "h2"], "left_semi")


def _cut(text_at: int, drops_at: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, drops in zip(utf8(batch.column(text_at)), batch.column(drops_at).to_pylist()):
                lines = text.split(b"\n")
                total.append(len(lines))
                if drops:
                    bad = {(d["h1"], d["h2"]) for d in drops}
                    lines = [x for x in lines if _key_hash(x.lower()) not in bad]
                gone.append(total[-1] - len(lines))
                texts.append(b"\n".join(lines))
            columns = [c for i, c in enumerate(batch.columns) if i not in (text_at, drops_at)]
            names = [n for i, n in enumerate(batch.schema.names) if i not in (text_at, drops_at)]
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            counts = [pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            made = pa.RecordBatch.from_arrays([*columns, kept, *counts], [*names, "_text", "_lines", "_dropped"])
            yield made

    return cut


def drop_common_lines(docs: DataFrame, min_docs: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines whose key is in ``min_docs`` documents or more.

    Adds n_lines (before) and n_dropped; columns of these names are replaced. A null text becomes
    an empty one.
    """
    keys = materialise(line_keys(docs, doc_id, text))
    counts = materialise(reference_counts(keys))
    common = materialise(counts.filter(F.col("n") >= min_docs))
    shards = shard_count(common)
    filters = build_filters(common, shards)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    repeated = materialise(ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if row_count(repeated):
        extra = surplus(attach(keys, repeated, ["doc_id"], "left_semi"))
        fewer = materialise(_changed(counts, extra, -1))
        filters, shards = follow(filters, counts, fewer, shards, min_docs)
        common = materialise(fewer.filter(F.col("n") >= min_docs))
    hits = common_lines(keys, common, filters, shards)
    drops = hits.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("_drops"))

    others = [c for c in docs.columns if c.lower() not in (text.lower(), "n_lines", "n_dropped")]
    inner = [f"c{i}" for i in range(len(others))]
    left = docs.select(
        *[F.col(f"`{c}`").alias(i) for c, i in zip(others, inner)],
        F.col(doc_id).cast("long").alias("_id"),
        F.col(text).cast("string").alias("_text"),
    )
    if not row_count(repeated):  # an id that repeats may be hot: then adaptive execution splits the join's partitions
        # The very expressions by which Spark compares ids that may be null, so that the join takes these parts as they are.
        left = left.repartition(shuffle_parts(docs), F.coalesce("_id", F.lit(0).cast("long")), F.isnull("_id"))
    joined = left.join(drops, F.col("_id").eqNullSafe(F.col("doc_id")), "left").select(*inner, "_text", "_drops")
    kinds = [f"{i} {joined.schema[i].dataType.simpleString()}" for i in inner]
    cut = joined.mapInArrow(
        _cut(len(inner), len(inner) + 1), ", ".join([*kinds, "_text string", "_lines long", "_dropped long"])
    )
    back = {i: c for c, i in zip(others, inner)}
    made = {**{back[i]: F.col(i) for i in inner}, text: F.col("_text")}
    order = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return cut.select(*[made[c].alias(c) for c in order], F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))
