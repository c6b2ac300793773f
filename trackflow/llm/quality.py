"""Quality rules: likelihood ratio of hashed n-grams between trusted documents and the whole corpus.

Words and word pairs are hashed to 2**16 buckets. Two multinomials over the buckets are counted: one from trusted
documents (label 1, four fifths of them), one from all documents. A document's score is the mean over its n-grams of
log(trusted / corpus), so long and short texts compare. The trusted multinomial is fitted on TRUSTED_ROWS documents at most, those
of the least hashes of their ids; corpus counts cover all documents. The remaining fifth of the labelled documents sets the
threshold: a histogram of their scores gives the cut that loses least, a lost good document weighing LOSS bad
ones; without held-out labels of both kinds it is DEFAULT_CUT. Every document is judged by it, and by
fixed rules on its form.

Words are runs without space and \\t to \\r. Counts cover all texts in whole; a model is two bounded arrays. Defined results:
a null or empty text has no words and fails; a document with several labels counts as trusted if all are 1; a
null doc_id has no label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackflow.llm.frames import chunks, utf8
from trackflow.llm.words import Sequences, Words, covered, mixed, window_starts
from trackflow.operators.tables import materialise

BITS = 16
TRUSTED_ROWS = 200_000  # labelled documents that the trusted side is fitted on
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
LOSS = 10
DEFAULT_CUT = -0.1
STEP = 0.005  # of the histogram of scores
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the number of the text of each."""
    owner = words.text_of_word()
    pairs = window_starts(words.first, 2)
    hashes = np.concatenate([words.hashes[0], Sequences(words.hashes[0]).of(pairs, 2)])
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([owner, owner[pairs]])


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(sums[ends])


def form(texts: list[bytes], words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    inside = np.zeros(len(words.buffer) + 1, np.int8)
    inside[words.starts] = 1
    inside[words.ends] -= 1
    letters = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((words.buffer & 0xC0) != 0x80)
    repeated = []
    for text in texts:
        seen: set[bytes] = set()
        again = 0
        for line in text.split(b"\n"):
            if line in seen:
                again += 1
            elif line.split():
                seen.add(line)
        repeated.append(again)
    starts = window_starts(words.first, WINDOW)
    owner = words.text_of_word()[starts].astype(np.uint64)
    keys = Sequences(words.hashes[0]).of(starts, WINDOW) ^ mixed(owner + np.uint64(1))
    _, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    twice = starts[n[which] > 1] if len(starts) else starts
    return {
        "n_words": np.diff(words.first),
        "word_chars": _per_text(letters, begins),
        "n_symbols": _per_text(_SYMBOL[words.buffer], begins),
        "n_dup_lines": np.array(repeated, np.int64),
        "n_repeat_words": _per_text(covered(words.n, twice, WINDOW), words.first),
    }


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket and task, whatever the task has read."""
    every, trusted = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        texts, good = utf8(batch.column(0)), np.array(batch.column(1).to_pylist(), bool)
        for a, b in chunks([len(t) for t in texts]):
            buckets, owner = ngrams(Words(texts[a:b]))
            every += np.bincount(buckets, minlength=1 << BITS)
            trusted += np.bincount(buckets[good[a:b][owner]], minlength=1 << BITS)
    at = np.flatnonzero(every)
    columns = [pa.array(at), pa.array(every[at]), pa.array(trusted[at])]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "corpus", "trusted"])


def model(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """The log ratio of each bucket. ``docs``: doc_id, text; ``trusted``: distinct doc_id.

    At most TRUSTED_ROWS ids are broadcast, so no text is shuffled: every document is counted where it is read.
    """
    drawn = trusted.orderBy(F.xxhash64("doc_id", F.lit("trusted")), "doc_id").limit(TRUSTED_ROWS)
    mark = materialise(drawn.select(F.col("doc_id").alias("_trusted")))
    marked = docs.join(F.broadcast(mark), F.col("doc_id") == F.col("_trusted"), "left").select("text", F.col("_trusted").isNotNull().alias("good"))
    sums = marked.mapInArrow(_counted, "bucket long, corpus long, trusted long").groupBy("bucket")
    rows = sums.agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted")).collect()  # 2**BITS rows at most
    corpus, good = np.ones(1 << BITS), np.ones(1 << BITS)
    for r in rows:
        corpus[r["bucket"]] += r["corpus"]
        good[r["bucket"]] += r["trusted"]
    if good.sum() == 1 << BITS:
        return np.zeros(1 << BITS)
    return np.log(good / good.sum()) - np.log(corpus / corpus.sum())


FORM = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, the columns of ``form``, score) per row; no words: score 0."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in chunks([len(t) for t in texts]):
                words = Words(texts[a:b])
                buckets, owner = ngrams(words)
                n = np.bincount(owner, minlength=b - a)
                mean = np.bincount(owner, ratio[buckets], b - a) / np.maximum(n, 1)
                found = form(texts[a:b], words)
                columns = [batch.column(0).slice(a, b - a), *[pa.array(found[c].astype(np.int64)) for c in FORM], pa.array(mean.astype(float))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *FORM, "score"])

    return docs.mapInArrow(score, f"doc_id long, {', '.join(f'{c} long' for c in FORM)}, score double")


def cut(scores: DataFrame, labels: DataFrame) -> float:
    """The threshold from held-out labels: ``scores`` (doc_id, score), ``labels`` (doc_id, quality)."""
    met = scores.join(labels, "doc_id").groupBy(F.floor(F.col("score") / STEP).alias("bin")).agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    )
    bins = sorted(met.collect(), key=lambda r: r["bin"])  # a mean of bounded log ratios: a few thousand bins at most
    if not sum(r["good"] for r in bins) or not sum(r["bad"] for r in bins):
        return DEFAULT_CUT
    lost, kept = 0, sum(r["bad"] for r in bins)
    best, at = kept, bins[0]["bin"]
    for r in bins:
        lost, kept = lost + r["good"], kept - r["bad"]
        if LOSS * lost + kept < best:
            best, at = LOSS * lost + kept, r["bin"] + 1
    return at * STEP


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the columns of ``form``, score, base_failed, kept) per row of ``docs``. ``labels``: doc_id, quality."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = materialise(known.agg(F.min("quality").alias("quality")))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    ratio = model(plain, known.filter(~held & (F.col("quality") == 1)))
    found = materialise(scored(plain, ratio))
    limit = cut(found.select("doc_id", "score"), known.filter(held))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= limit))
