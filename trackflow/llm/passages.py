"""Repeated passages: difference-cover anchors, extended to windows of 35 words.

A word is removed if a window of 35 consecutive words of one document covers it whose word sequence
also starts anywhere else, in the same document or another. The positions modulo 21 that lie in the
difference cover {3, 6, 7, 12, 14} are anchors: for any two word positions, one of the 21 shifts
puts both on anchor positions, so two equal windows of 35 words share an aligned anchor of 15 words.

1. Documents are packed into blocks (a few MB of text, compressed), once, dealt by block number.
2. Each block gives its distinct anchor hashes; a hash in two blocks, or twice in one, is repeated.
3. Each block extends repeated anchors to all windows that hold one, and gives those
   windows' distinct 96-bit hashes; a hash in one block only, and once there, is single. Few are.
4. Each block removes the words covered by windows that hold a repeated anchor and are not single.

A passage shared by any number of documents costs one row per block, not per document or pair. Blocks
are the unit of shuffling; the same exchange serves steps 2 to 4.

Words are runs without space and \\t to \\r, unchanged. Defined results: null and empty texts have no words;
repeated rows are documents of their own; null doc_ids stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackflow.llm.frames import chunks, shuffle_parts, utf8
from trackflow.llm.words import BYTE_BASES, Sequences, Words, covered, window_starts

WINDOW = 35
PERIOD = 21
COVER = (3, 6, 7, 12, 14)  # every difference modulo 21 occurs
ANCHOR = WINDOW - PERIOD + 1
BLOCK_BYTES = 4 << 20


def _pack(texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(b" ".join(t.split()) for t in texts))


def _unpack(block: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompressobj().decompress(block).split(b"\n")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids, texts, total = [], [], 0

    def made() -> pa.RecordBatch:
        columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([_pack(texts)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "texts"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            if ids and total + len(text) > BLOCK_BYTES:
                yield made()
                number += 1
                ids, texts, total = [], [], 0
            ids.append(doc)
            texts.append(text)
            total += len(text)
    if ids:
        yield made()


def _chunked(texts: list[bytes], bases: tuple[int, ...]) -> Iterator[tuple[list[bytes], Words]]:
    for a, b in chunks([len(t) for t in texts]):
        yield texts[a:b], Words(texts[a:b], bases)


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all anchors, and their hashes."""
    at = window_starts(words.first, ANCHOR)
    place = at - np.repeat(words.first[:-1], np.diff(words.first))[at]
    wanted = np.zeros(PERIOD, bool)
    wanted[list(COVER)] = True
    at = at[wanted[place % PERIOD]]
    return at, Sequences(words.hashes[0]).of(at, ANCHOR)


def _candidates(words: Words, repeated: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a repeated anchor; ``repeated`` is sorted."""
    at, hashes = _anchors(words)
    hit = np.zeros(words.n + 1, np.int64)
    hit[at[_member(hashes, repeated)]] = 1
    before = np.cumsum(hit) - hit
    starts = window_starts(words.first, WINDOW)
    return starts[before[starts + PERIOD] > before[starts]]


def _window_hashes(words: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = Sequences(words.hashes[0]).of(starts, WINDOW)
    two = Sequences(words.hashes[1]).of(starts, WINDOW)
    return one, (two >> np.uint64(32)).astype(np.uint32)


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _give_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(2)):
            found = [_anchors(words)[1] for _, words in _chunked(_unpack(packed.as_py()), BYTE_BASES[:1])]
            hashes, n = np.unique(_joined(found, np.uint64), return_counts=True)
            columns = [pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), block)), pa.array(n > 1)]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "block", "twice"])


def _sorted_numbers(column: pa.Array, row: int) -> np.ndarray:
    """The row's list of hashes, sorted as unsigned numbers."""
    value = column[row]
    return np.sort(value.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) if value.is_valid else np.zeros(0, np.uint64)


def _distinct_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order of the first number, and which of them came twice."""
    order = np.argsort(one, kind="stable")
    if np.any((one[order][1:] == one[order][:-1]) & (two[order][1:] != two[order][:-1])):
        order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    at = np.flatnonzero(new)
    return one[at], two[at], np.diff(np.append(at, len(one))) > 1


def _member_pairs(one: np.ndarray, two: np.ndarray, of_one: np.ndarray, of_two: np.ndarray) -> np.ndarray:
    """Which pairs are in the distinct pairs ``of_one``, ``of_two``, ordered by the first number."""
    found = np.zeros(len(one), bool)
    if len(of_one):
        at, last = np.searchsorted(of_one, one), len(of_one) - 1
        open_ = np.ones(len(one), bool)
        while open_.any():
            here = np.minimum(at, last)
            open_ &= (of_one[here] == one) & (at <= last)
            found |= open_ & (of_two[here] == two)
            at = at + 1
    return found


def _give_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: block, doc_ids, texts, repeated anchors."""
    for batch in batches:
        for row in range(batch.num_rows):
            repeated = _sorted_numbers(batch.column(3), row)
            one, two = [], []
            for _, words in _chunked(_unpack(batch.column(2)[row].as_py()), BYTE_BASES):
                a, b = _window_hashes(words, _candidates(words, repeated))
                one.append(a)
                two.append(b)
            h1, h2, twice = _distinct_pairs(_joined(one, np.uint64), _joined(two, np.uint32))
            block = np.full(len(h1), batch.column(0)[row].as_py())
            columns = [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)), pa.array(block), pa.array(twice)]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "block", "twice"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: block, doc_ids, texts, repeated anchors, single windows (two lists of the same order)."""
    for batch in batches:
        for row in range(batch.num_rows):
            repeated = _sorted_numbers(batch.column(3), row)
            one, two = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            if batch.column(4)[row].is_valid:
                one = batch.column(4)[row].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                two = batch.column(5)[row].values.to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32)
                one, two, _ = _distinct_pairs(one, two)
            n_words, n_removed, kept = [], [], []
            for texts, words in _chunked(_unpack(batch.column(2)[row].as_py()), BYTE_BASES):
                starts = np.zeros(0, np.int64)
                if len(repeated):
                    starts = _candidates(words, repeated)
                    starts = starts[~_member_pairs(*_window_hashes(words, starts), one, two)]
                gone = covered(words.n, starts, WINDOW)
                before = np.concatenate([[0], np.cumsum(gone)])
                for d, text in enumerate(texts):
                    lo, hi = int(words.first[d]), int(words.first[d + 1])
                    lost = int(before[hi] - before[lo])
                    n_words.append(hi - lo)
                    n_removed.append(lost)
                    if lost:
                        text = b" ".join([w for w, g in zip(text.split(), gone[lo:hi].tolist()) if not g])
                    kept.append(text)
            texts_left = pa.array(kept, pa.binary()).cast(pa.string())
            counts = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            ids = batch.column(1)[row].values
            yield pa.RecordBatch.from_arrays([ids, *counts, texts_left], ["doc_id", "n_words", "n_removed", "text"])


def _seen(hashes: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``repeated``: whether the hash is in more than one block or twice in one.

    Rows are distinct per block, so a hash has at most a row per block.
    """
    same = Window.partitionBy(*keys)
    return hashes.withColumn("repeated", (F.count(F.lit(1)).over(same) > 1) | F.col("twice"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text) per row: the kept words joined by one space."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = plain.mapInArrow(_blocks, "block long, doc_ids array<long>, texts binary")
    # All three uses read the same columns, so that Spark shuffles the blocks once.
    blocks = packed.repartition(shuffle_parts(plain), "block")

    anchors = blocks.mapInArrow(_give_anchors, "h1 long, block long, twice boolean")
    anchors = _seen(anchors, ["h1"]).filter("repeated").groupBy("block").agg(F.collect_list("h1").alias("anchors"))
    windows = blocks.join(anchors, "block").select("block", "doc_ids", "texts", "anchors")
    windows = windows.mapInArrow(_give_windows, "h1 long, h2 int, block long, twice boolean")
    windows = _seen(windows, ["h1", "h2"]).filter("NOT repeated").groupBy("block")
    windows = windows.agg(F.collect_list(F.struct("h1", "h2")).alias("windows"))
    whole = blocks.join(anchors, "block", "left").join(windows, "block", "left")
    return whole.select(
        "block", "doc_ids", "texts", "anchors", F.col("windows.h1").alias("h1"), F.col("windows.h2").alias("h2")
    ).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, text string")
