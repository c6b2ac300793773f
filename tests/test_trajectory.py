"""Segments, speed cleaning and smoothing on hand-made tracks."""

import pytest
from pyspark.sql import functions as F

from trackflow.operators import trajectory
from trackflow.operators.ordered import time_chunk

CHUNKS = [20, 3600]


def kept(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


def plain_clean(rows, max_speed):
    """The same rule, row by row: judge all, drop, repeat until nothing changes."""
    alive = list(rows)
    while True:
        speeds = []
        for (_, t, x), (_, t2, x2) in zip(alive, alive[1:]):
            d, s = abs(x2 - x), t2 - t
            speeds.append(None if s == 0 and d == 0 else float("inf") if s == 0 else d / s)
        ok = [
            (i == len(alive) - 1 or speeds[i] is None or speeds[i] < max_speed)
            and (i == 0 or speeds[i - 1] is None or speeds[i - 1] < max_speed)
            for i in range(len(alive))
        ]
        if all(ok):
            return [r[0] for r in alive]
        alive = [r for r, k in zip(alive, ok) if k]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_same_time_fixes(fixes, chunk):
    # No move in no time is kept; a move in no time is infinitely fast.
    still = fixes([("s", "HO01", "06:00:00", 0, 0), ("s", "HO01", "06:00:00", 0, 0), ("s", "HO01", "06:01:00", 5, 0)])
    assert kept(trajectory.drop_speed_outliers(still, chunk=time_chunk(seconds=chunk))) == [0, 1, 2]
    jump = fixes([("s", "HO01", "06:00:00", 0, 0), ("s", "HO01", "06:00:00", 3, 0), ("s", "HO01", "06:01:00", 5, 0)])
    assert kept(trajectory.drop_speed_outliers(jump, chunk=time_chunk(seconds=chunk))) == [2]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_outlier_chain_needs_several_passes(fixes, chunk):
    xs = [0, 50, 1000, 1010, 2000, 60, 300, 310, 320]
    rows = [("s", "HO01", f"06:00:{i * 5:02d}", x, 0) for i, x in enumerate(xs)]
    other = [("s", "HO02", f"06:00:{i * 5:02d}", i, 0) for i in range(4)]
    got = kept(trajectory.drop_speed_outliers(fixes(rows + other), 7.0, chunk=time_chunk(seconds=chunk)))
    want = plain_clean([(i, i * 5, x) for i, x in enumerate(xs)], 7.0)
    assert got == want + [9, 10, 11, 12]
    again = trajectory.drop_speed_outliers(fixes(rows + other).filter(F.col("event_id").isin(got)), 7.0, chunk=time_chunk(seconds=chunk))
    assert kept(again) == got


def test_single_fix_has_no_segment(fixes):
    row = trajectory.drop_speed_outliers(fixes([("s", "HO01", "06:00:00", 1, 2)])).head()
    assert row["steplength"] is None and row["speed"] is None and row["x2"] is None


def test_satellites_as_number_and_as_text(spark):
    df = spark.createDataFrame([(1, 3), (2, 4), (3, 10), (4, None)], "event_id long, nsat int")
    assert kept(trajectory.enough_satellites(df)) == [2, 3]
    assert kept(trajectory.enough_satellites(df, as_text=True)) == [2]


def test_smooth_copies_the_nearest_mean_to_the_ends(spark):
    df = spark.createDataFrame([("r", i, float(x), 0.0) for i, x in enumerate([0, 3, 9, 9, 30])], "route string, seq long, x double, y double")
    got = [r["x"] for r in trajectory.smooth(df, ["route"], ["x", "y"]).orderBy("seq").collect()]
    assert got == [4.0, 4.0, 7.0, 16.0, 16.0]


def test_moving_keeps_unknown_steps(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.1), (3, None)], "event_id long, steplength double")
    assert kept(trajectory.moving(df)) == [2, 3]


@pytest.mark.parametrize("seed, chunk", [(1, 30), (2, 120), (3, 3600), (4, 60)])
def test_cleaning_against_row_by_row(spark, seed, chunk):
    import numpy as np

    rng = np.random.default_rng(seed)
    rows, want = [], []
    for animal in ("HO01", "HO02", "HO03"):
        n = 150 if animal == "HO01" else 20
        times = np.sort(rng.integers(0, n * 6, n))
        xs = np.cumsum(rng.normal(0, 12, n)) + np.where(rng.random(n) < 0.25, rng.normal(0, 120, n), 0)
        own = [(len(rows) + i, int(t), float(x)) for i, (t, x) in enumerate(zip(times, xs))]
        want += plain_clean(own, 7.0)
        rows += [(i, animal, t, x) for i, t, x in own]
    df = spark.createDataFrame(rows, "event_id long, animal_id string, s long, x double").selectExpr(
        "event_id", "'a' as session_id", "animal_id", "timestamp_seconds(s) as time", "x", "0D as y"
    )
    cleaned = trajectory.drop_speed_outliers(df, 7.0, chunk=time_chunk(seconds=chunk))
    assert kept(cleaned) == sorted(want) and len(want) < len(rows)
    # The segments are those of the remaining fixes.
    again = trajectory.segments(df.filter(F.col("event_id").isin(want)))
    columns = ["event_id", "time2", "x2", "y2", "timelag", "steplength", "speed"]
    assert sorted(map(tuple, cleaned.select(*columns).collect()), key=repr) == sorted(map(tuple, again.select(*columns).collect()), key=repr)
