"""Segment tests at their edges, and the map projection."""

import pytest
from pyspark.sql import functions as F

from trackflow.functions import geometry as g


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


GATE = g.Line(0, -1, 0, 1)


@pytest.mark.parametrize(
    "line, meets, share",
    [
        ((-1, 0, 1, 0), True, 0.5),
        ((-1, 0, 0, 0), True, 1.0),  # ends on the gate
        ((0, 0, 3, 0), True, 0.0),  # starts on it
        ((-1, 1, 1, 1), True, 0.5),  # through its end
        ((-1, 2, 1, 2), False, None),
        ((0, -3, 0, 3), True, 1 / 3),  # along it: the first shared point
        ((0, 3, 0, -3), True, 1 / 3),
        ((0, 0.5, 0, 3), True, 0.0),
        ((0, 2, 0, 3), False, None),  # in line with it but apart
        ((0, 0.5, 0, 0.5), True, 0.0),  # no length, on the gate
        ((1, 1, 1, 1), False, None),
    ],
)
def test_segment_meets_gate(spark, line, meets, share):
    assert value(spark, g.intersects(g.Line(*line), GATE)) is meets
    if meets:
        assert value(spark, g.cut_share(g.Line(*line), GATE)) == pytest.approx(share)


def test_missing_end_is_no_segment(spark):
    nothing = F.lit(None).cast("double")
    assert value(spark, g.intersects(g.Line(0, 0, nothing, nothing), GATE)) is False


def test_point_segment_distance(spark):
    line = g.Line(0, 0, 10, 0)
    for (x, y), d in {(5, 3): 3, (-3, 4): 5, (13, -4): 5}.items():
        assert value(spark, g.point_segment_distance(F.lit(float(x)), F.lit(float(y)), line)) == d
    assert value(spark, g.point_segment_distance(F.lit(3.0), F.lit(4.0), g.Line(0, 0, 0, 0))) == 5


def test_projection(spark):
    # The grid's origin and its published longitude and latitude.
    lon, lat = g.lv95_to_wgs84(F.lit(2600000.0), F.lit(1200000.0))
    assert value(spark, lon) == pytest.approx(7.438632, abs=2e-5)
    assert value(spark, lat) == pytest.approx(46.951083, abs=2e-5)
    lon, lat = g.lv95_to_wgs84(F.lit(2780425.0), F.lit(1161875.0))
    east, north = g.wgs84_to_lv95(lon, lat)
    assert value(spark, east) == pytest.approx(2780425, abs=1.5)
    assert value(spark, north) == pytest.approx(1161875, abs=1.5)


def test_haversine(spark):
    one_degree = g.haversine(F.lit(9.0), F.lit(46.0), F.lit(9.0), F.lit(47.0))
    assert value(spark, one_degree) == pytest.approx(111195, abs=1)


def test_route_distances(spark):
    """Routes of 1 to 400 segments, against every segment; fixes without a place have no distance."""
    import math
    import random

    from trackflow.operators import trips

    r = random.Random(2)
    vertices = {"a": 401, "b": 2, "c": 51, "point": 1, "d": 17}
    ways = {name: [(r.uniform(0, 900), r.uniform(0, 300)) for _ in range(n)] for name, n in vertices.items()}
    routes = spark.createDataFrame([(n, i, x, y) for n, w in ways.items() for i, (x, y) in enumerate(w)], "route string, seq long, x double, y double")
    points = [(i, r.uniform(-100, 1000), r.uniform(-100, 400)) for i in range(60)] + [(60, *ways["a"][7]), (61, None, 5.0), (62, None, None)]
    fixes = spark.createDataFrame(points, "event_id long, x double, y double")

    def far(x, y, one, two):
        (x1, y1), (x2, y2) = one, two
        dx, dy = x2 - x1, y2 - y1
        t = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x1 + t * dx - x, y1 + t * dy - y)

    got = {(r["route"], r["event_id"]): r["dist"] for r in trips.route_distances(fixes, routes, list(ways), ["event_id"]).collect()}
    want = {(n, i): None if x is None else min(far(x, y, *s) for s in zip(w, w[1:])) for n, w in ways.items() if len(w) > 1 for i, x, y in points}
    assert got.keys() == want.keys()
    assert all(got[k] == v or got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_attach_counts_bytes(spark, monkeypatch):
    """A few rows of long arrays are not broadcast."""
    from trackflow.operators import tables

    dim = tables.materialise(spark.range(3).withColumn("line", F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda i: F.rand(1) * i)))
    fact = spark.range(10)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(tables.attach(fact, dim, ["id"])).lower()
    monkeypatch.setattr(tables, "MAX_BROADCAST_BYTES", 1 << 20)
    joined = tables.attach(fact, dim, ["id"])
    assert "broadcast" not in plan(joined).lower() and joined.filter("size(line) > 0").count() == 3
