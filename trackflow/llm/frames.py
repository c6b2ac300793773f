"""Small helpers that the text operators share: column names, Arrow batches, chunks of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20  # of the rows that a Python worker gets at once
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
UNKNOWN_BYTES = 1 << 50
PART_BYTES = 64 << 20  # stored bytes of a table that one task of a shuffle should get


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name that no column of ``df`` has (names differ beyond letter case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with ``new`` at its end; columns of these names are replaced, whatever their letter case."""
    names = {n.lower() for n in new}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(sizes: Sequence[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` together; a longer text is alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python workers in batches of about BATCH_BYTES, or the limit it has if that is less.

    Without a limit in bytes a batch is 10,000 rows however long their texts, and an executor holds it for every core,
    in the JVM (up to three times, as its buffers grow by doubling) and in the worker.
    """
    has = spark.conf.get(BATCH_LIMIT, None)
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if has is None or not 0 < bytes_of(has) <= BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def give_back() -> None:
    """Returns to the system what Arrow and the C library keep of freed memory; a worker lives on and would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def shuffle_parts(df: DataFrame) -> int:
    """Into how many parts the rows of ``df`` are shuffled: the session's number, more where the tables' stored bytes ask for it.

    Spark's estimate for a table that is no file is far beyond UNKNOWN_BYTES; then the session's number holds.
    """
    stored = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if stored > UNKNOWN_BYTES else max(least, -(-stored // PART_BYTES))


def as_text(column: str) -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
