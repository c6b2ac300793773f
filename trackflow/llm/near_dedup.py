"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

Words are longest runs without space and \\t to \\r, with A-Z lower-cased; a text's set is its
distinct 5-word shingles, or the whole sequence if it has fewer words. Two documents are linked
if their sets' Jaccard similarity is 0.75 or more, confirmed on whole sets.

1. One pass hashes every shingle once; the hash's top bits choose one of 128 bins, each bin keeps
   its least value, and an empty bin takes over the value of a bin drawn by a hash of its own number
   until that one is filled (optimal densification). 32 bands of 4 bins make the buckets; a pair at
   0.75 shares none with probability 0.0000055.
2. Equal sets are one class at once; from here on only the smallest doc_id of each class takes part.
3. In each bucket a hub is compared with the others (a star), so a round makes at most one pair
   per member and hub. Confirmed links are joined to components. Buckets whose members are not in one
   component yet go into another round with other hubs. A hub leaves the bucket once it has been
   compared, so every two members of different components meet, unless the shingles that they
   can share at most are too few: no link is lost, and copies are not expanded into all pairs.

Defined results: a text without words has an empty set and no links. Rows that share a doc_id are in one
component; each of their texts is compared as a set of its own. A row with a null doc_id takes no part in links; its component is null and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackflow.llm.frames import chunks, free_name, utf8, with_columns
from trackflow.llm.words import LENGTH_STEP, Sequences, Words, mixed
from trackflow.operators.tables import materialise, row_count

BINS = 128
BANDS = 32
WIDTH = 5
SHARE = 75  # per cent
FIRST_HUBS = 4
_SHIFT = np.uint64(64 - 7)  # 2**7 bins


def _draws() -> np.ndarray:
    """For each bin the bins it asks when it is empty: random draws, at last all others in order."""
    n = np.arange(BINS * 256, dtype=np.uint64).reshape(BINS, 256)
    random = (mixed(n + np.uint64(LENGTH_STEP)) % np.uint64(BINS)).astype(np.int64)
    rest = (np.arange(BINS)[:, None] + np.arange(BINS)[None, :]) % BINS
    return np.concatenate([random, rest], axis=1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    words = Words([t.lower() for t in texts])
    seq = Sequences(words.hashes[0])
    sets = []
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = end - begin
        if n > WIDTH:
            sets.append(np.unique(seq.of(np.arange(begin, end - WIDTH + 1), WIDTH)))
        else:
            sets.append(seq.of(np.arange(begin, begin + min(n, 1)), n))
    return sets


def minima(shingles: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a sorted set that is not empty."""
    first = np.searchsorted(shingles, np.arange(BINS, dtype=np.uint64) << _SHIFT)
    filled = np.append(first[1:], len(shingles)) > first
    values = shingles[np.minimum(first, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        asked = draws[empty]
        hit = filled[asked].argmax(axis=1)
        values[empty] = values[asked[np.arange(len(empty)), hit]]
    return values


def band_hashes(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, BINS // BANDS)
    factors = mixed(np.arange(1, BINS // BANDS + 1, dtype=np.uint64)) | np.uint64(1)
    return mixed((rows * factors).sum(axis=1, dtype=np.uint64) + mixed(np.arange(BANDS, dtype=np.uint64)))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set that do not depend on its order."""
    one, two = (_signed(mixed(s).sum(keepdims=True, dtype=np.uint64)) for s in (shingles, shingles ^ np.uint64(LENGTH_STEP)))
    return int(one[0]), int(two[0])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    draws = _draws()
    for batch in batches:
        texts = utf8(batch.column(1))
        size, one, two, bands = [], [], [], []
        for a, b in chunks([len(t) for t in texts]):
            for s in shingle_sets(texts[a:b]):
                size.append(len(s))
                for sums, value in zip((one, two), fingerprint(s)):
                    sums.append(value)
                bands.append(_signed(band_hashes(minima(s, draws))).tolist() if len(s) else None)
        made = [pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n_shingles", "set1", "set2", "bands"])


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set1, set2, bands): size, 128-bit fingerprint and band hashes of each row's set."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _signatures, "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>"
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column(1))
        for a, b in chunks([len(t) for t in texts]):
            sets = shingle_sets(texts[a:b])
            sums = [fingerprint(s) for s in sets]
            ends = np.cumsum([0, *[len(s) for s in sets]])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(np.concatenate(sets)), pa.int64()))
            made = [pa.array(v, pa.int64()) for v in ([len(s) for s in sets], [x for x, _ in sums], [x for _, x in sums])]
            names = ["doc_id", "n_shingles", "set1", "set2", "shingles"]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made, flat], names)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached over ``edges`` (a, b).

    Every pass gives each node the least label among its neighbours and itself, then the label's own label
    (pointer jumping), until no label changes. Groups are reduced by partial minima, so a large
    component is no hot group.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("component").alias("near"))
        low = materialise(
            labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        )
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = materialise(
            low.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("next", "component")).alias("component"))
        )
        labels = after.select("node", "component")
        if after.filter("component != was").isEmpty():
            return labels


def _shared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, na, nb) with ``shared``, the size of the intersection of their sets (node, shingles)."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(left, "a").join(right, "b")
    return met.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"))


def _possible(n, other_n, shared):
    """Whether sets of these sizes that share at most ``shared`` shingles can be similar enough."""
    return shared * (100 + SHARE) >= (n + other_n) * SHARE


def _shareable(alive: DataFrame, sets: DataFrame) -> DataFrame:
    """``alive`` with ``common``: how many shingles of the node any other node of ``alive`` has."""
    nodes = alive.select("node").distinct()
    single = sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    single = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n = 1")
    single = single.groupBy("node").agg(F.count(F.lit(1)).alias("single"))
    joined = alive.join(single, "node", "left").withColumn("common", F.col("n") - F.coalesce("single", F.lit(0)))
    return materialise(joined.drop("single"))


def _links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes. ``members``: (bucket, node, n), only buckets of two or more.

    From the second round on, a pair that cannot be similar is left out: shingles that no other open
    member has cannot be shared, and what two members share lies in what both share with the second round's hub,
    or beside it. From then on a bucket's hub is its most typical member, the one with the
    smallest share of such shingles; from the third round on it comes from outside the bucket's largest
    component, and further hubs are drawn there, four times as many each round.
    """
    alive = members.withColumns({"component": F.col("node"), "common": F.col("n"), "inner": F.lit(0).cast("long")})
    labels, tested, turn = None, None, 0
    own = F.struct("node", "n", "common", "inner", "component")
    typical = F.struct((1 - F.col("common") / F.col("n")).alias("odd"), (-F.col("n")).alias("short"), "node")
    while True:
        if turn:
            parts = alive.groupBy("bucket").agg(F.min("component").alias("one"), F.max("component").alias("other"))
            alive = alive.join(parts.filter("one != other").select("bucket"), "bucket", "left_semi")
            alive = materialise(alive)
            if not row_count(alive):
                break
            if turn == 1:
                alive = _shareable(alive, sets)
            least = alive.groupBy("bucket").agg(F.min("n").alias("least"))
            fit = _possible(F.col("n"), F.col("least"), F.col("common"))
            alive = materialise(alive.join(least, "bucket").filter(fit).drop("least"))
        if turn < 2:
            by = F.struct("node") if turn == 0 else typical
            hubs = alive.groupBy("bucket").agg(F.min_by(own, by).alias("hub")).select("bucket", "hub.*")
        else:
            sizes = alive.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
            largest = sizes.groupBy("bucket").agg(
                F.max(F.struct("size", "component"))["component"].alias("largest"), (F.sum("size") - F.max("size")).alias("outside")
            )
            outside = alive.join(largest, "bucket").filter("component != largest")
            outside = outside.withColumn("draw", F.xxhash64("bucket", "node"))
            first = outside.groupBy("bucket").agg(F.min_by("node", typical).alias("first"))
            share = (F.pmod(F.col("draw"), F.lit(1 << 20)) + 1) / float(1 << 20)
            chosen = (F.col("node") == F.col("first")) | ((share * F.col("outside") <= FIRST_HUBS ** (turn - 2)) & F.lit(turn > 2))
            hubs = outside.join(first, "bucket").filter(chosen).select("bucket", "node", "n", "common", "inner", "component")
        hubs = materialise(hubs)
        # A pair that meets in several buckets counts in the first one only.
        every = F.collect_list("bucket").over(Window.partitionBy("node"))
        alive = alive.withColumn("buckets", every)
        named = hubs.withColumn("buckets", every)
        named = named.select(*[F.col(c).alias(f"hub_{c}") for c in named.columns])
        meet = F.col("bucket") == F.col("hub_bucket")
        # The second round's hub meets its whole bucket: what both share with it and beside it bounds later pairs.
        meet = meet & (F.col("node") != F.col("hub_node") if turn == 1 else F.col("component") != F.col("hub_component"))
        most = F.least("n", "hub_n", "common", "hub_common")
        if turn > 1:
            beside = F.least(F.col("common") - F.col("inner"), F.col("hub_common") - F.col("hub_inner"))
            most = F.least(most, F.least("inner", "hub_inner") + beside)
        if turn != 1:
            meet = meet & _possible(F.col("n"), F.col("hub_n"), most)
        meet = meet & (F.array_min(F.array_intersect("buckets", "hub_buckets")) == F.col("bucket"))
        lower = F.col("node") < F.col("hub_node")
        pairs = alive.join(named, meet).select(
            F.least("node", "hub_node").alias("a"),
            F.greatest("node", "hub_node").alias("b"),
            F.when(lower, F.col("n")).otherwise(F.col("hub_n")).alias("na"),
            F.when(lower, F.col("hub_n")).otherwise(F.col("n")).alias("nb"),
        )
        pairs = pairs.distinct()
        if turn > 1:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        counted = materialise(_shared(pairs, sets))
        found = counted.filter(_possible(F.col("na"), F.col("nb"), F.col("shared"))).select("a", "b")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        labels = joined(labels, found)
        rest = alive.join(hubs.select("bucket", "node"), ["bucket", "node"], "left_anti").drop("component", "buckets")
        rest = rest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn == 1:
            hub = hubs.select("bucket", F.col("node").alias("hub"))
            met = counted.select("a", "b", "shared")
            by_node = met.select(F.col("a").alias("node"), F.col("b").alias("hub"), "shared")
            by_node = by_node.unionByName(met.select(F.col("b").alias("node"), F.col("a").alias("hub"), "shared"))
            rest = rest.join(hub, "bucket").join(by_node, ["node", "hub"], "left").withColumn("inner", F.coalesce("shared", "common"))
        alive = rest.select("bucket", "node", "n", "common", "inner", "component")
        turn += 1
    return labels


def joined(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """The components after the links ``found`` (written, a and b) between nodes."""
    if labels is None:
        return components(found)
    if found.isEmpty():
        return labels
    ends = found.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    ends = ends.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    lifted = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    lifted = lifted.withColumnRenamed("component", "into")
    known = labels.join(lifted.withColumnRenamed("node", "component"), "component", "left")
    known = known.select("node", F.coalesce("into", "component").alias("component"))
    fresh = lifted.select("node", F.col("into").alias("component")).join(labels, "node", "left_anti")
    return materialise(known.unionByName(fresh))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept), written."""
    signed = materialise(signatures(docs, doc_id, text))
    named = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = ["n_shingles", "set1", "set2"]
    equal = materialise(named.groupBy(*key).agg(F.min("doc_id").alias("rep")))
    # A set's node is its smallest doc_id, or a number of its own where that doc_id has other sets, too.
    several = materialise(equal.groupBy("rep").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("rep", F.lit(True).alias("several")))
    reused = row_count(several) > 0
    equal = equal.withColumn("node", F.col("rep"))
    if reused:
        own = -1 - F.pmod(F.xxhash64("rep", *key), F.lit(1 << 62))
        equal = materialise(equal.join(several, "rep", "left").withColumn("node", F.when(F.col("several"), own).otherwise(F.col("rep"))).drop("several"))
    per_class = named.join(equal, key).filter("doc_id = rep")
    spread = per_class.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    spread = spread.select("bucket", "node", "n").distinct()
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket")
    members = materialise(spread.join(shared, "bucket", "left_semi"))
    nodes = materialise(members.select("node").distinct())
    wanted = nodes.withColumn("doc_id", F.col("node"))
    if reused:
        wanted = nodes.join(equal, "node").select("node", F.col("rep").alias("doc_id"), *key)
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    needed = whole.join(wanted.select("doc_id").distinct() if reused else wanted, "doc_id", "left_semi")
    needed = needed.mapInArrow(_sets, "doc_id long, n_shingles long, set1 long, set2 long, shingles array<long>")
    needed = needed.join(wanted, ["doc_id", *key]) if reused else needed.withColumnRenamed("doc_id", "node")
    sets = materialise(needed.select("node", "shingles"))
    if row_count(sets) > row_count(nodes):  # repeated rows
        sets = materialise(sets.dropDuplicates(["node"]))
    labels = _links(members, sets)
    found = named.select("doc_id", *key).join(equal, key).select("doc_id", "node").join(labels, "node", "left")
    found = found.select("doc_id", F.coalesce("component", "node").alias("label"))
    # A doc_id repeated with different texts ties their components together.
    tied = materialise(found.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")))
    split = tied.filter("label != other").select(F.col("label").alias("a"), F.col("other").alias("b"))
    if not split.isEmpty():
        ties = found.join(tied.filter("label != other").select("doc_id", F.col("label").alias("low")), "doc_id")
        over = components(ties.select(F.col("label").alias("a"), F.col("low").alias("b")))
        over = over.withColumnRenamed("node", "label").withColumnRenamed("component", "over")
        tied = tied.join(over, "label", "left").withColumn("label", F.coalesce("over", "label"))
    if reused:
        lowest = tied.groupBy("label").agg(F.min("doc_id").alias("lowest"))
        tied = tied.join(lowest, "label").withColumn("label", F.col("lowest"))
    final = signed.select("doc_id", "n_shingles").join(tied.select("doc_id", "label"), "doc_id", "left")
    component = F.coalesce("label", "doc_id").alias("component_id")
    kept = F.coalesce(F.coalesce("label", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    return final.select("doc_id", "n_shingles", component, kept)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each group of near duplicates only.

    Rows that repeat the kept doc_id stay. Rows with a null doc_id stay.
    """
    gone = classes(docs, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col("_gone"), "left_anti")
