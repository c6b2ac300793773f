"""SimHash near-duplicates: 64-bit fingerprints that differ in three bits at most are linked.

Words are longest runs without space and \\t to \\r, with A-Z lower-cased. A shingle is three words joined by a space, repeats
count; a text of fewer words is one shingle. A fingerprint bit is 1 if it is set in over half of the shingles'
XXH64 hashes (seed 42).

1. Equal fingerprints are one class, so copies are one row from here on.
2. Fingerprints are eight bytes. Three bits lie in three bytes at most, so linked fingerprints share five positional bytes or
   more. The inverted index files a fingerprint under its bytes at four positions, for the 14 sets of four positions whose
   numbers have exclusive or 0. Any three positions lie in one such set and the other four positions make another, so two fingerprints that
   share five bytes meet in a list of the index.
3. In each list the shared positional bytes of a pair are tallied; pairs that reach five are verified by their differing bits.
   A pair counts in its first common list only, and a link of two fingerprints that a smaller one of the list is linked with is
   left out, so a dense group makes few links a fingerprint, not all its pairs.
4. Lists of more than LIST fingerprints make no pairs. Fingerprints at most one bit from a third value are linked through it (two bits
   apart at most), and such a value has 65 neighbours at most. Between what is not in one component yet, three bits are
   met half way: one bit from one end, two bits from the other, within the positions that the list leaves free. Each
   meeting place links its least one-bit neighbour with all others. These links and the pairs have the same
   components as all pairs would have, and grow in proportion to the list.

Defined results: a null text, an empty one or one without words has the fingerprint zero and is linked like any other. Every row
keeps its own fingerprint, repeated rows and doc_ids, too; rows that share a doc_id are in one component, as whatever reaches one of them
reaches that doc_id. A row with a null doc_id links, but gives its component no name: the component is null if no other row is in it.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.llm.frames import chunks, utf8
from trackflow.llm.near_dedup import components, joined
from trackflow.operators.tables import materialise, row_count

WIDTH = 3
SEED = 42
BITS = 3  # differing bits of a link
LIST = 64  # fingerprints of a list that is compared pair by pair
MIN_BYTES = 8 - BITS
HASHES = 1 << 16  # hashes whose bits are counted at once


def _mask(positions) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


BLOCKS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
MASKS = [_signed(_mask(b)) for b in BLOCKS]


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(WIDTH, len(words))
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        little = hashes[at : at + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(little, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * count > len(hashes)).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column(1))
        for a, b in chunks([len(t) for t in texts]):
            made = pa.array([_signed(fingerprint(t)) for t in texts[a:b]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), made], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; the fingerprint as a signed 64-bit number."""
    one = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return one.mapInArrow(_fingerprints, "doc_id long, fp long")


def _any_of(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def shared_bytes(x: Column) -> Column:
    """The positional bytes that two fingerprints of exclusive or ``x`` share."""
    total = F.lit(0)
    for p in range(8):
        total = total + (x.bitwiseAND(F.lit(_signed(0xFF << (8 * p)))) == 0).cast("int")
    return total


def postings(fps: DataFrame) -> DataFrame:
    """(block, bytes, fp): each fingerprint in its lists of the index."""
    filed = [F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(MASKS)]
    return fps.select("fp", F.explode(F.array(*filed)).alias("k")).select("k.block", "k.bytes", "fp")


def pairs(lists: DataFrame) -> DataFrame:
    """Links (a, b) within lists (block, fps) of bounded size, fps in order: tallied, then verified.

    Of three fingerprints linked with each other the link of the two larger ones is left out: the least one connects them.
    """
    masks = _any_of(MASKS)

    def link(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        return (shared_bytes(x) >= MIN_BYTES) & (F.bit_count(x) <= BITS)

    def first(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        return F.array_position(F.transform(masks, lambda m: x.bitwiseAND(m) == 0), True) == F.col("block") + 1

    def of(a: Column, i: Column) -> Column:
        close = F.filter(F.slice("fps", F.lit(1), i), lambda b: link(a, b))
        # In an array of one, so that it is worked out once.
        apart = lambda bs: F.filter(bs, lambda b, j: first(a, b) & ~F.exists(F.slice(bs, F.lit(1), j), lambda c: link(b, c)))
        return F.flatten(F.transform(F.array(close), lambda bs: F.transform(apart(bs), lambda b: F.struct(a.alias("a"), b.alias("b")))))

    return lists.select("block", F.explode(F.flatten(F.transform("fps", of))).alias("p")).select("p.a", "p.b")


def near_links(fps: DataFrame) -> DataFrame:
    """Links that connect all fingerprints at most two bits apart, through the values one bit away from both."""
    around = F.concat(F.array(F.col("fp")), F.transform(_any_of([_signed(1 << i) for i in range(64)]), lambda b: F.col("fp").bitwiseXOR(b)))
    met = fps.select("fp", F.explode(around).alias("v")).groupBy("v").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b").distinct()


def far_links(members: DataFrame) -> DataFrame:
    """Links between fingerprints of different labels, three bits apart at most, in the same list.

    ``members``: (block, bytes, fp, label). In each list the most frequent label's members go one bit far, the others
    two bits as well.
    """
    key = ["block", "bytes"]
    sizes = members.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.groupBy(*key).agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels"))
    several = materialise(members.join(large.filter("labels > 1"), key))
    free = [[p for p in range(8) if p not in b] for b in BLOCKS]
    flips = [[_signed(1 << (8 * p + i)) for p in f for i in range(8)] for f in free]
    ones = F.element_at(F.array(*[_any_of(f) for f in flips]), F.col("block") + 1)
    near = F.concat(F.array(F.col("fp")), F.transform(ones, lambda b: F.col("fp").bitwiseXOR(b)))
    one = several.select("block", "fp", "label", F.explode(near).alias("v"))
    hubs = one.groupBy("block", "v").agg(F.min_by(F.struct(F.col("fp").alias("a"), F.col("label").alias("la")), "fp").alias("hub"))
    # Two further bits by two steps of one; a value reached twice is joined twice and its link is distinct again.
    others = several.filter("label != main").select("block", "fp", "label", F.explode(near).alias("u"))
    again = F.transform(ones, lambda b: F.col("u").bitwiseXOR(b))
    two = others.select("block", "fp", "label", F.explode(F.concat(F.array(F.col("u")), again)).alias("v")).distinct()
    met = two.join(hubs, ["block", "v"]).filter("label != hub.la")
    return met.select("hub.a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame) -> DataFrame:
    """(node, component) of all linked fingerprints of ``fps`` (distinct, written)."""
    key = ["block", "bytes"]
    filed = postings(fps)
    sizes = materialise(filed.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    small = filed.join(sizes.filter(F.col("size") <= LIST).select(*key), key)
    lists = small.groupBy(*key).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    found = pairs(lists)
    large = sizes.filter(F.col("size") > LIST).select(*key)
    if large.isEmpty():
        return components(found)
    members = materialise(filed.join(large, key))
    found = materialise(found.unionByName(near_links(members.select("fp").distinct())))
    labels = components(found)
    named = members.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("component", "fp"))
    further = materialise(far_links(named.select(*key, "fp", "label")))
    return joined(labels, further)


def tied(signed: DataFrame, labelled: DataFrame) -> DataFrame:
    """``labelled`` (fp, low, component) with the components joined that one doc_id of ``signed`` (doc_id, fp) has rows in."""
    ids = signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("one"), F.max("fp").alias("other"))
    several = materialise(ids.filter("one != other").select("doc_id"))
    if not row_count(several):
        return labelled
    met = materialise(signed.join(several, "doc_id").join(labelled, "fp").select("doc_id", "component").distinct())
    least = met.groupBy("doc_id").agg(F.min("component").alias("least"))
    over = components(met.join(least, "doc_id").select(F.col("component").alias("a"), F.col("least").alias("b")))
    over = over.select(F.col("node").alias("component"), F.col("component").alias("over"))
    return materialise(labelled.join(over, "component", "left").select("fp", "low", F.coalesce("over", "component").alias("component")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, fp, component_id), the smallest doc_id that links reach."""
    signed = materialise(fingerprints(docs, doc_id, text))
    distinct = materialise(signed.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labelled = distinct.join(links(distinct.select("fp")).withColumnRenamed("node", "fp"), "fp", "left")
    labelled = tied(signed, materialise(labelled.select("fp", "low", F.coalesce("component", "fp").alias("component"))))
    lowest = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    named = labelled.join(lowest, "component").select("fp", "component_id")
    return signed.join(named, "fp").select("doc_id", "fp", "component_id")
