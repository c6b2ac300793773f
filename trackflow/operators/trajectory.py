"""Track cleaning and per-fix movement columns.

A track is one animal in one session. Its fixes are ordered by time and, for
equal times, event_id.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.functions.columns import AUXILIARY_SUFFIX, seconds_between
from trackflow.functions.geometry import distance
from trackflow.operators.ordered import neighbours, running_total, seq_chunk, time_chunk
from trackflow.operators.tables import attach, materialise, row_count

TRACK = ["session_id", "animal_id"]
ORDER = ["time", "event_id"]

# Thresholds of the analysis.
MAX_SPEED = 7.0
MIN_SATELLITES = 4
MIN_STEP = 5.0


def drop_auxiliary(df: DataFrame, suffix: str = AUXILIARY_SUFFIX) -> DataFrame:
    return df.filter(~F.col("session_id").endswith(suffix))


def drop_sessions(df: DataFrame, sessions: list[str]) -> DataFrame:
    return df.filter(~F.col("session_id").isin(sessions))


def enough_satellites(df: DataFrame, least: int = MIN_SATELLITES, as_text: bool = False) -> DataFrame:
    """Keeps fixes from at least ``least`` satellites; NULL counts are dropped.

    ``as_text`` compares the counts as strings, so that '10' < '4'.
    """
    if as_text:
        return df.filter(F.col("nsat").cast("string") > str(least - 1))
    return df.filter(F.col("nsat") >= least)


def moving(df: DataFrame, min_step: float = MIN_STEP) -> DataFrame:
    """Keeps fixes whose step is longer than ``min_step`` or unknown."""
    return df.filter(F.col("steplength").isNull() | (F.col("steplength") > min_step))


def step_length(df: DataFrame, keys: list[str] = TRACK, chunk: Column | None = None) -> DataFrame:
    """Distance to the next fix of the track; NULL for the last."""
    placed = neighbours(
        df, keys, ORDER, {"_nx": ("x", 1), "_ny": ("y", 1)}, time_chunk() if chunk is None else chunk
    )
    step = distance(F.col("x"), F.col("y"), F.col("_nx"), F.col("_ny"))
    return placed.withColumn("steplength", step).drop("_nx", "_ny")


def _speed(step: Column, seconds: Column) -> Column:
    """Step over time; a jump in no time is infinitely fast, no move is unknown."""
    return F.when(seconds == 0, F.when(step > 0, F.lit(float("inf")))).otherwise(step / F.when(seconds != 0, seconds))


def _with_segment(df: DataFrame) -> DataFrame:
    step = distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    measured = df.withColumn("timelag", seconds_between(F.col("time"), F.col("time2"))).withColumn("steplength", step)
    return measured.withColumn("speed", _speed(F.col("steplength"), F.col("timelag")))


def segments(df: DataFrame, keys: list[str] = TRACK, chunk: Column | None = None) -> DataFrame:
    """Adds the segment to the next fix: time2, x2, y2, timelag, steplength, speed."""
    ahead = {"time2": ("time", 1), "x2": ("x", 1), "y2": ("y", 1)}
    return _with_segment(neighbours(df, keys, ORDER, ahead, time_chunk() if chunk is None else chunk))


def _slow(a: str, b: str, max_speed: float) -> Column:
    """The way from the place with suffix ``a`` to the one with ``b`` is slow enough or unknown."""
    step = distance(F.col(f"x{a}"), F.col(f"y{a}"), F.col(f"x{b}"), F.col(f"y{b}"))
    seconds = seconds_between(F.col(f"time{a}"), F.col(f"time{b}"))
    return F.coalesce(_speed(step, seconds) < max_speed, F.lit(True))


def _places(*offsets: int) -> dict[str, tuple[str, int]]:
    """Neighbour columns time_1, x_1, y_1, id_1 (one after), time_b1 (one before), ..."""
    names = {o: f"_{o}" if o > 0 else f"_b{-o}" for o in offsets}
    found = {f"{c}{n}": (c, o) for o, n in names.items() for c in ("time", "x", "y")}
    return found | {f"id{n}": ("event_id", o) for o, n in names.items()}


def drop_speed_outliers(
    df: DataFrame, max_speed: float = MAX_SPEED, keys: list[str] = TRACK, chunk: Column | None = None
) -> DataFrame:
    """Removes both ends of every too fast segment until none is left.

    Returns the remaining fixes with their segments. All fixes are judged and
    shuffled once. A later pass can only change fixes next to a gap left by
    removed ones, so it looks at those alone: in order, the fixes on both
    sides of a gap follow each other. When such a fix goes too, the next one
    outwards is fetched from the written fixes.
    """
    chunk = time_chunk() if chunk is None else chunk
    gap = F.col("gap_before") | F.col("gap_after")
    judged = materialise(_judge_all(df, max_speed, keys, chunk))
    zone = judged.filter(gap)
    fetched: list[DataFrame] = []
    while True:
        seen, wanted = _judge_gaps(zone, max_speed, keys, chunk)
        if row_count(seen.removed) == 0:
            break
        wanted = materialise(wanted)
        more = attach(judged.drop("gap_before", "gap_after"), wanted, [*keys, "event_id"], "inner")
        zone = seen.left.unionByName(more)
        fetched.append(wanted.select(*keys, "event_id"))
    untouched = judged.filter(~gap)
    if fetched:
        untouched = attach(untouched, materialise(reduce(DataFrame.unionByName, fetched)), [*keys, "event_id"], "left_anti")
    whole = untouched.unionByName(seen.left)
    return _with_segment(whole.drop("gap_before", "gap_after", "prev_id", "next_id"))


def _judge_all(df: DataFrame, max_speed: float, keys: list[str], chunk: Column) -> DataFrame:
    """The fixes that survive the first pass, and whether a neighbour did not."""
    near = neighbours(df, keys, ORDER, _places(1, 2, -1, -2), chunk)
    slow_out, slow_in = _slow("", "_1", max_speed), _slow("_b1", "", max_speed)
    # The neighbours stay if the ways on their other sides are slow as well;
    # the way between is, where this fix stays.
    judged = near.withColumns(
        {
            "gap_after": F.col("id_1").isNotNull() & ~_slow("_1", "_2", max_speed),
            "gap_before": F.col("id_b1").isNotNull() & ~_slow("_b2", "_b1", max_speed),
        }
    ).filter(slow_out & slow_in)
    return judged.select(
        *df.columns,
        F.col("time_1").alias("time2"),
        F.col("x_1").alias("x2"),
        F.col("y_1").alias("y2"),
        F.col("id_b1").alias("prev_id"),
        F.col("id_1").alias("next_id"),
        "gap_before",
        "gap_after",
    )


class _Gaps(NamedTuple):
    left: DataFrame
    removed: DataFrame


def _judge_gaps(zone: DataFrame, max_speed: float, keys: list[str], chunk: Column) -> tuple[_Gaps, DataFrame]:
    """One later pass over the fixes at gaps: who stays (with its new segment), who goes,
    and which fixes beyond them are at a gap now."""
    gaps = {f"{g}{n}": (g, o) for g in ("gap_before", "gap_after") for n, o in (("_1", 1), ("_b1", -1))}
    near = neighbours(zone, keys, ORDER, _places(1, 2, -1, -2) | gaps, chunk)

    def gone(before: str, here: str, after: str, suffix: str) -> Column:
        return (F.col(f"gap_after{suffix}") & ~_slow(here, after, max_speed)) | (
            F.col(f"gap_before{suffix}") & ~_slow(before, here, max_speed)
        )

    judged = materialise(
        near.withColumns(
            {
                "_gone": gone("_b1", "", "_1", ""),
                "_gone_after": F.coalesce(gone("", "_1", "_2", "_1"), F.lit(False)),
                "_gone_before": F.coalesce(gone("_b2", "_b1", "", "_b1"), F.lit(False)),
            }
        )
    )
    # A neighbour without a gap between is in the table only if it is at
    # another gap.
    joined_after = F.coalesce(F.col("id_1") == F.col("next_id"), F.lit(False))
    joined_before = F.coalesce(F.col("id_b1") == F.col("prev_id"), F.lit(False))
    stays = judged.filter(~F.col("_gone")).withColumns(
        {c: F.when(F.col("gap_after"), F.col(f"{c[:-1]}_1")).otherwise(F.col(c)) for c in ("time2", "x2", "y2")}
    )
    stays = stays.withColumns(
        {
            "gap_after": F.col("gap_after") | (joined_after & F.col("_gone_after")),
            "gap_before": F.col("gap_before") | (joined_before & F.col("_gone_before")),
        }
    )
    removed = judged.filter("_gone").select(*keys, "event_id")
    beyond = F.array_compact(
        F.array(
            F.when(
                ~F.col("gap_after") & ~joined_after & F.col("next_id").isNotNull(),
                F.struct(F.col("next_id").alias("event_id"), F.lit(True).alias("before"), F.lit(False).alias("after")),
            ),
            F.when(
                ~F.col("gap_before") & ~joined_before & F.col("prev_id").isNotNull(),
                F.struct(F.col("prev_id").alias("event_id"), F.lit(False).alias("before"), F.lit(True).alias("after")),
            ),
        )
    )
    asked = judged.filter("_gone").select(*keys, F.explode(beyond).alias("_ask")).select(*keys, "_ask.*")
    wanted = asked.groupBy(*keys, "event_id").agg(
        F.bool_or("before").alias("gap_before"), F.bool_or("after").alias("gap_after")
    )
    return _Gaps(stays.select(*zone.columns), removed), wanted


def smooth(df: DataFrame, keys: list[str], columns: list[str], order: str = "seq") -> DataFrame:
    """Centred mean over three rows; the first and last row copy their neighbour's mean."""
    wanted = {}
    for c in columns:
        for o in (-2, -1, 1, 2):
            wanted[f"_{c}_{o}"] = (c, o)
    near = neighbours(df, keys, [order], wanted, seq_chunk(order))
    smoothed = {}
    for c in columns:
        two_back, back, here, ahead, two_ahead = (
            F.col(n) for n in (f"_{c}_-2", f"_{c}_-1", c, f"_{c}_1", f"_{c}_2")
        )
        smoothed[c] = (
            F.when(back.isNull(), (here + ahead + two_ahead) / 3.0)
            .when(ahead.isNull(), (two_back + back + here) / 3.0)
            .otherwise((back + here + ahead) / 3.0)
        )
    return near.withColumns(smoothed).drop(*wanted)


def cumulative_distance(
    df: DataFrame, keys: list[str], order: list[str], step: str, chunk: Column, name: str = "cum_dist"
) -> DataFrame:
    """Running path length; ``step`` is the distance from the row before (NULL counts as 0)."""
    return running_total(df, keys, order, F.coalesce(F.col(step), F.lit(0.0)), chunk, name)
