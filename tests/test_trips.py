"""Trips, crossings, snapshots on small hand-made herds."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackflow.functions.geometry import Line
from trackflow.operators import crossings, routes, snapshots, trajectory, trips

START, END = Line(100.0, -50.0, 100.0, 50.0), Line(400.0, -50.0, 400.0, 50.0)


def walk(animal, begin, xs, session="01-01-M", step=30):
    at = datetime.datetime(2024, 1, 1, *map(int, begin.split(":")))
    return [(session, animal, (at + datetime.timedelta(seconds=step * i)).strftime("%H:%M:%S"), x, 0) for i, x in enumerate(xs)]


OUT_WALK = [0, 60, 120, 180, 240, 300, 360, 420]


def test_one_way_has_no_way_back(fixes):
    segs = trajectory.segments(fixes(walk("HO01", "06:00:00", OUT_WALK)))
    events = trips.trip_events(segs, START, END)
    window = trips.session_windows(events).head()
    assert window["out_from"] is not None and window["out_to"] is not None
    assert window["back_from"] is None and window["back_to"] is None
    labelled = trips.label_trips(segs, trips.session_windows(events))
    assert {r["direction"] for r in labelled.collect()} == {"out"}
    done = trips.complete_trips(events).head()
    assert done["out_complete"] is True and done["back_complete"] is False


def test_overlapping_windows_have_no_direction(fixes):
    rows = walk("HO01", "06:00:00", OUT_WALK) + walk("HO02", "06:01:00", OUT_WALK[::-1])
    segs = trajectory.segments(fixes(rows))
    events = trips.trip_events(segs, START, END)
    labelled = trips.label_trips(segs, trips.session_windows(events))
    assert labelled.filter("direction is null").count() > 0
    assert trips.keep_complete(labelled, trips.complete_trips(events)).filter("direction is null").count() == 0


def test_turning_back_is_no_trip(fixes):
    segs = trajectory.segments(fixes(walk("HO01", "06:00:00", [0, 60, 120, 180, 120, 60, 0])))
    events = trips.trip_events(segs, START, END)
    assert events.count() == 2
    assert events.filter("out_start or back_start or out_end or back_end").count() == 0


@pytest.fixture
def herd(fixes, spark):
    rows = []
    for i, animal in enumerate(["HO01", "HO02", "HW01", "OB01"]):
        rows += walk(animal, f"06:00:{(0, 0, 20, 40)[i]:02d}", [x + (0, 0, 3, 5)[i] for x in OUT_WALK])
    segs = trajectory.segments(fixes(rows)).withColumns({"direction": F.lit("out"), "route": F.lit("r")})
    gates = spark.createDataFrame([("r", 0, *START), ("r", 1, 250.0, -50.0, 250.0, 50.0), ("r", 2, *END)], "route string, gate_no int, x1 double, y1 double, x2 double, y2 double")
    return segs, gates


def test_equal_crossing_seconds_share_the_mean_rank(herd):
    segs, gates = herd
    cr = crossings.crossings(segs, gates)
    assert cr.count() == 12
    ranked = crossings.rank_at_gates(cr).toPandas()
    for _, at_gate in ranked.groupby("gate_no"):
        assert at_gate["rank"].sum() == 4 * 5 / 2
        assert at_gate["gap"].min() == 0
        assert at_gate.set_index("animal_id").loc[["HO01", "HO02"], "rank"].tolist() == [1.5, 1.5]
    first = crossings.leaders(cr).collect()
    assert {r["leader_id"] for r in first} == {"HO01"} and len(first) == 3


def test_crossing_lies_within_its_segment(herd):
    hits = crossings.all_crossings(*herd).withColumn("ok", F.expr("share between 0 and 1 and crossing_time between time - interval 1 second and time2 + interval 1 second"))
    assert hits.filter("not ok").count() == 0


def test_only_the_first_crossing_counts(fixes, spark):
    segs = trajectory.segments(fixes(walk("HO01", "06:00:00", [0, 200, 0, 200]))).withColumns({"direction": F.lit("out"), "route": F.lit("r")})
    gates = spark.createDataFrame([("r", 0, *START)], "route string, gate_no int, x1 double, y1 double, x2 double, y2 double")
    assert crossings.all_crossings(segs, gates).count() == 3
    (row,) = crossings.crossings(segs, gates).collect()
    assert row["crossing_time"] == datetime.datetime(2024, 1, 1, 6, 0, 15)


@pytest.mark.parametrize("ties", [True, False])
def test_asof_joins_against_brute_force(spark, ties, monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKET_SECONDS", 40)
    rng = np.random.default_rng(3)
    base = pd.Timestamp("2024-01-01 06:00:00")
    fx = pd.DataFrame({"event_id": range(300), "session_id": rng.choice(["a", "b"], 300, p=[0.8, 0.2]), "animal_id": rng.choice(["p", "q", "r"], 300), "s": rng.integers(0, 900, 300)})
    rf = pd.DataFrame({"session_id": rng.choice(["a", "b"], 40), "gate_no": range(40), "s": rng.integers(-50, 1000, 40)})
    fx["time"], rf["ref_time"] = base + pd.to_timedelta(fx["s"], unit="s"), base + pd.to_timedelta(rf["s"], unit="s")
    fixes, refs = spark.createDataFrame(fx.drop(columns="s")), spark.createDataFrame(rf.drop(columns="s"))
    both = rf.merge(fx, on="session_id", suffixes=("_r", ""))
    both["d"] = both["s_r"] - both["s"]
    past = both[both["d"] >= 0].sort_values(["s", "event_id"], ascending=[False, True])
    want = past.groupby(["gate_no", "animal_id"])["event_id"].first()
    got = snapshots.asof_last(fixes, refs, ["session_id"], ["animal_id"]).toPandas()
    assert got.set_index(["gate_no", "animal_id"])["event_id"].sort_index().to_dict() == want.to_dict()
    both["d"] = both["d"].abs()
    near = both[both["d"] == both.groupby(["gate_no", "animal_id"])["d"].transform("min")]
    if not ties:
        near = near.sort_values(["s", "event_id"]).groupby(["gate_no", "animal_id"]).head(1)
    got = snapshots.asof_nearest(fixes, refs, ["session_id"], ["animal_id"], ties).toPandas()
    assert sorted(map(tuple, got[["gate_no", "animal_id", "event_id"]].to_numpy().tolist())) == sorted(map(tuple, near[["gate_no", "animal_id", "event_id"]].to_numpy().tolist()))


def test_route_and_gates_of_an_l_shaped_walk(fixes):
    xs = [(i * 10, 0) for i in range(8)] + [(70, j * 10) for j in range(1, 5)]
    track = fixes([("s", "HO01", f"06:{i:02d}:00", x, y) for i, (x, y) in enumerate(xs)])
    route = routes.build_route(track, "way", "s", "HO01", 7).orderBy("seq").collect()
    assert [r["seq"] for r in route] == list(range(12))
    assert (route[0]["x"], route[1]["x"]) == (10.0, 10.0)  # the end copies its neighbour's mean
    lines = {r["seq"]: r for r in routes.perpendicular_lines(routes.build_route(track, "way", "s", "HO01", 7), 20.0, 2).collect()}
    assert lines[0]["x1"] is None and lines[11]["x1"] is None
    assert (lines[3]["x1"], lines[3]["x2"]) == (30.0, 30.0) and {lines[3]["y1"], lines[3]["y2"]} == {-10.0, 10.0}


def test_gate_lines_must_be_shared(spark):
    gates = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0, 4.0), ("b", 0, 1.0, 2.0, 3.0, 5.0)], "route string, gate_no int, x1 double, y1 double, x2 double, y2 double")
    with pytest.raises(ValueError):
        routes.gate_lines(gates, 0)
    assert routes.gate_lines(gates.filter("route = 'a'"), 0) == [Line(1.0, 2.0, 3.0, 4.0)]
