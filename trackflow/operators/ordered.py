"""Ordered computations that do not need a whole group in one task.

A plain window hands each group to one task. Here every group is cut into
chunks by an expression that never decreases along the order (a time bucket, a
value range), and windows run per (group, chunk). Only the rows at the chunk
edges, or the chunk totals, meet in a window per group. The rows themselves are
shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackflow.operators.tables import attach, materialise, row_count

CHUNK_SECONDS = 900
ROWS_PER_RANGE = 50_000
MOST_RANGES = 1024


def time_chunk(time: str = "time", seconds: int = CHUNK_SECONDS) -> Column:
    return F.floor(F.unix_micros(F.col(time)) / F.lit(seconds * 1_000_000))


def seq_chunk(seq: str = "seq", size: int = 4096) -> Column:
    return F.floor(F.col(seq) / F.lit(size))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    wanted: dict[str, tuple[str, int]],
    chunk: Column,
) -> DataFrame:
    """Adds columns taken from rows before (negative) or after (positive).

    ``wanted`` maps a new column to (column, offset). ``order`` must be total
    within a group.
    """
    offsets = sorted({o for _, o in wanted.values()})
    # A row looking ``o`` ahead past its chunk's end needs the next chunk's
    # first ``o`` rows, so both ends count as edges.
    reach = max(abs(o) for o in offsets)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    along = Window.partitionBy(*keys).orderBy(*order)

    def shift(what: Column, offset: int, w) -> Column:
        return (F.lead(what, offset) if offset > 0 else F.lag(what, -offset)).over(w)

    # What neighbours show travels as one struct instead of its columns, so
    # nothing but the order is shuffled twice. A neighbour is NULL only where
    # the chunk has no such row.
    shown = list(dict.fromkeys(c for c, _ in wanted.values()))
    packed = [c for c in shown if c not in keys and c not in order]
    plain = [c for c in df.columns if c not in packed]
    near = df.select(*plain, F.struct(*shown).alias("_row"), chunk.alias("_chunk")).withColumns(
        {
            f"_at_{o}": shift(F.col("_row") if o in offsets else F.lit(1), o, inside)
            for o in sorted({*offsets, reach, -reach})
        }
    )
    whole = F.col(f"_at_{reach}").isNotNull() & F.col(f"_at_{-reach}").isNotNull()
    # The first and last rows of all chunks, in order: from a row near a
    # chunk's end the next ones here are the next ones of the group.
    edges = near.filter(~whole).withColumns(
        {f"_at_{o}": F.coalesce(F.col(f"_at_{o}"), shift(F.col("_row"), o, along)) for o in offsets}
    )
    both = near.filter(whole).unionByName(edges)
    own = [F.col("_row")[c].alias(c) if c in packed else F.col(c) for c in df.columns]
    found = [F.col(f"_at_{o}")[c].alias(name) for name, (c, o) in wanted.items()]
    return both.select(*own, *found)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    chunk: Column,
    name: str,
    combine: Callable[[str], Column] = F.sum,
) -> DataFrame:
    """Adds the inclusive running sum (min, max) of ``value`` along ``order`` per group."""
    part = [*keys, "_chunk"]
    chunked = df.withColumn("_chunk", chunk).withColumn("_value", value)
    totals = chunked.groupBy(*part).agg(combine("_value").alias("_total"))
    along = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(
        *part, combine("_total").over(along).alias("_value"), F.lit(True).alias("_edge")
    ).filter(F.col("_value").isNotNull())
    both = chunked.withColumn("_edge", F.lit(False)).unionByName(start, allowMissingColumns=True)
    w = (
        Window.partitionBy(*part)
        .orderBy(F.col("_edge").desc(), *order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        both.withColumn(name, combine("_value").over(w))
        .filter(~F.col("_edge"))
        .drop("_edge", "_chunk", "_value")
    )


def within_time(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    before_s: float,
    after_s: float,
    totals: dict[str, Column],
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Adds aggregates over the rows of the group from ``before_s`` before to ``after_s`` after each row's time, both ends included.

    Each row goes to its own chunk and, as a copy, to those next chunks whose rows' windows reach it; chunks are at least as
    wide as the window, so there are three at most, and one shuffle. Rows without a time have windows of their own kind:
    they see each other only.
    """
    width = max(chunk_seconds, math.ceil(before_s + after_s)) * 1_000_000
    before, after = round(before_s * 1e6), round(after_s * 1e6)
    at = F.unix_micros(F.col(time))
    chunk = F.floor(F.col("_at") / F.lit(width))
    seen_by = F.sequence(F.floor((F.col("_at") - after) / F.lit(width)), F.floor((F.col("_at") + before) / F.lit(width)))
    copies = df.withColumn("_at", at).withColumn("_chunk", F.explode(F.coalesce(seen_by, F.array(F.lit(None).cast("long")))))
    near = Window.partitionBy(*keys, "_chunk").orderBy("_at").rangeBetween(-before, after)
    found = copies.withColumns({name: total.over(near) for name, total in totals.items()})
    return found.filter(F.col("_chunk").eqNullSafe(chunk)).drop("_at", "_chunk")


def value_chunk(counted: DataFrame, value: str, rows_per_range: int | None = None) -> Column:
    """Chunk number by value range; cut points are approximate quantiles of a written table.

    There are as many ranges as the table needs to hold about ROWS_PER_RANGE rows each, MOST_RANGES at most; a small table is one.
    A value finds its range through a list of lists of cuts, so it is compared with about twice the root of their number.
    """
    chunks = min(MOST_RANGES, -(-row_count(counted) // (rows_per_range or ROWS_PER_RANGE)))
    if chunks <= 1:
        return F.lit(0).cast("bigint")
    shares = [i / chunks for i in range(1, chunks)]
    cuts = counted.agg(F.percentile_approx(value, shares).alias("cuts")).head()["cuts"] or []
    steps = sorted({float(c) for c in cuts})
    if not steps:
        return F.lit(0).cast("bigint")
    width = math.isqrt(len(steps) - 1) + 1
    lists = [steps[i : i + width] for i in range(0, len(steps), width)]
    passed = lambda held: F.size(F.filter(held, lambda c: c <= F.col(value)))
    whole = passed(F.array(*[F.lit(g[-1]) for g in lists]))
    rest = F.get(F.array(*[F.array(*map(F.lit, g)) for g in lists]), whole)
    return (whole * width + F.when(rest.isNotNull(), passed(rest)).otherwise(0)).cast("bigint")


def value_counts(df: DataFrame, keys: Sequence[str], value: str, chunk: Column | None = None) -> DataFrame:
    """Per group and distinct value: its count ``n`` and the running count ``upto``.

    A value held by any number of rows is one row after the partial aggregate.
    Without a ``chunk`` the counts are written, to cut the values into ranges.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    if chunk is None:
        counted = materialise(counted)
        chunk = value_chunk(counted, value)
    return running_total(counted, keys, [value], F.col("n"), chunk, "upto")


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, chunk: Column | None = None) -> DataFrame:
    """Rank within each group, equal values sharing the mean of their ranks.

    Rows without a value have no rank.
    """
    counts = value_counts(df, keys, value, chunk)
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
    return df.join(counts.select(*keys, value, rank.alias(name)), [*keys, value], "left")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], chunk: Column | None = None
) -> DataFrame:
    """Exact quantiles per group, linear between neighbours; one column per share."""
    counts = materialise(value_counts(df, keys, value, chunk))
    sizes = counts.groupBy(*keys).agg(F.max("upto").alias("_size"))
    spots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in shares.items()])
    places = sizes.withColumn("_s", F.explode(spots)).select(
        *keys, F.col("_s.k").alias("_k"), (F.col("_s.p") * (F.col("_size") - 1)).alias("_pos")
    )
    places = materialise(places)
    first = F.col("upto") - F.col("n")
    low, high = F.floor("_pos"), F.ceil("_pos")
    hit_low = (first <= low) & (low < F.col("upto"))
    hit_high = (first <= high) & (high < F.col("upto"))
    if keys:
        found = attach(counts, places, list(keys), "inner", hit_low | hit_high)
    else:
        found = attach(
            counts.withColumn("_all", F.lit(1)), places.withColumn("_all", F.lit(1)), ["_all"], "inner", hit_low | hit_high
        )
    at_low = F.max(F.when(hit_low, F.col(value)))
    at_high = F.max(F.when(hit_high, F.col(value)))
    points = found.groupBy(*keys, "_k", "_pos").agg(at_low.alias("_lo"), at_high.alias("_hi"))
    share = F.col("_pos") - F.floor("_pos")
    points = points.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share)
    return points.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, F.col("_q"))).alias(k) for k in shares])
