"""Written intermediate tables, and joins to small or large side tables.

Intermediate results are written as parquet under ``spark.checkpoint.dir``
(the shared folder a cluster names). That cuts lineage, survives lost
executors, and gives later steps column pruning, pushdown and true sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
# Columnar files are about this much smaller than the same rows in memory.
PACKED = 4

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="trackflow-")
    return _local_dirs[app]


def working_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/trackflow-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` once and returns a DataFrame that reads it back.

    The rows are counted as they are written; ``row_count`` knows them.
    """
    spark = df.sparkSession
    path = f"{working_dir(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._row_count = seen.get["rows"]
    return written


def row_count(df: DataFrame) -> int:
    """The number of rows, without a job for a table just written by ``materialise``."""
    known = getattr(df, "_row_count", None)
    return df.count() if known is None else known


def byte_size(df: DataFrame) -> int:
    """About how many bytes the rows of a table just written by ``materialise`` take in memory; 0 for other tables."""
    if getattr(df, "_row_count", None) is None:
        return 0
    return PACKED * int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def drop_working_tables(spark: SparkSession) -> None:
    """Removes every intermediate table this application wrote."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(working_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def attach(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "left",
    condition: Column | None = None,
    max_broadcast_rows: int | None = None,
) -> DataFrame:
    """Equi-join of a large table with a side table whose size is checked first.

    ``dim`` should be a written or local table, so that counting it is cheap.
    Up to ``max_broadcast_rows`` rows (MAX_BROADCAST_ROWS) and MAX_BROADCAST_BYTES it is broadcast and ``fact`` is not
    shuffled; arrays in a row count with their bytes. Beyond that it is a plain join, in which adaptive execution splits the partitions of
    hot keys of ``fact``; nothing is repeated for keys that are not hot. Both ways give the same rows.
    ``how`` is inner, left, left_semi or left_anti; ``condition`` restricts the match further.
    """
    limit = MAX_BROADCAST_ROWS if max_broadcast_rows is None else max_broadcast_rows
    if row_count(dim) <= limit and byte_size(dim) <= MAX_BROADCAST_BYTES:
        left, right, on = fact, F.broadcast(dim), list(keys)
    else:
        left, right, on = fact, dim, list(keys)
    if condition is None:
        joined = left.join(right, on, how)
    else:
        renamed = right
        for c in on:
            renamed = renamed.withColumnRenamed(c, f"_dim_{c}")
        match = condition
        for c in on:
            match = match & (F.col(c) == F.col(f"_dim_{c}"))
        joined = left.join(renamed, match, how).drop(*[f"_dim_{c}" for c in on])
    return joined
