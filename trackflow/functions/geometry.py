"""Planar geometry on double columns, and the Swiss grid / WGS84 conversion."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Line(NamedTuple):
    """A two-point line; members are numbers or Columns."""

    x1: object
    y1: object
    x2: object
    y2: object

    def columns(self) -> "Line":
        return Line(*(v if isinstance(v, Column) else F.lit(float(v)) for v in self))



def segment_columns() -> Line:
    """The outgoing segment of a fix: (x, y) to (x2, y2)."""
    return Line(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))


def gate_columns() -> Line:
    return Line(F.col("gx1"), F.col("gy1"), F.col("gx2"), F.col("gy2"))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def intersects(a: Line, b: Line) -> Column:
    """Closed intersection of two segments: touching and collinear overlap count."""
    a, b = a.columns(), b.columns()
    boxes = (
        (F.least(a.x1, a.x2) <= F.greatest(b.x1, b.x2))
        & (F.least(b.x1, b.x2) <= F.greatest(a.x1, a.x2))
        & (F.least(a.y1, a.y2) <= F.greatest(b.y1, b.y2))
        & (F.least(b.y1, b.y2) <= F.greatest(a.y1, a.y2))
    )
    bdx, bdy = b.x2 - b.x1, b.y2 - b.y1
    adx, ady = a.x2 - a.x1, a.y2 - a.y1
    a_split = _cross(bdx, bdy, a.x1 - b.x1, a.y1 - b.y1) * _cross(bdx, bdy, a.x2 - b.x1, a.y2 - b.y1)
    b_split = _cross(adx, ady, b.x1 - a.x1, b.y1 - a.y1) * _cross(adx, ady, b.x2 - a.x1, b.y2 - a.y1)
    # NULL ends (the last fix of a track) are no segment; least/greatest skip
    # NULLs, so test for them.
    present = a.x2.isNotNull() & a.y2.isNotNull()
    return present & boxes & (a_split <= 0) & (b_split <= 0)


def cut_share(a: Line, b: Line) -> Column:
    """Where on ``a`` (0 start .. 1 end) it meets ``b``; collinear: first shared point."""
    a, b = a.columns(), b.columns()
    adx, ady = a.x2 - a.x1, a.y2 - a.y1
    bdx, bdy = b.x2 - b.x1, b.y2 - b.y1
    den = _cross(adx, ady, bdx, bdy)
    crossing = _cross(b.x1 - a.x1, b.y1 - a.y1, bdx, bdy) / F.when(den != 0, den)
    length2 = F.when(adx * adx + ady * ady > 0, adx * adx + ady * ady)
    at1 = ((b.x1 - a.x1) * adx + (b.y1 - a.y1) * ady) / length2
    at2 = ((b.x2 - a.x1) * adx + (b.y2 - a.y1) * ady) / length2
    overlap = F.greatest(F.lit(0.0), F.least(at1, at2))
    return F.when(den != 0, crossing).otherwise(F.coalesce(overlap, F.lit(0.0)))


def point_segment_distance(x: Column, y: Column, line: Line) -> Column:
    line = line.columns()
    dx, dy = line.x2 - line.x1, line.y2 - line.y1
    length2 = dx * dx + dy * dy
    along = ((x - line.x1) * dx + (y - line.y1) * dy) / F.when(length2 > 0, length2)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(along, F.lit(0.0))))
    return distance(x, y, line.x1 + t * dx, line.y1 + t * dy)


# The published approximate formulas of the Swiss federal
# mapping agency between the LV95 grid and WGS84 degrees (about 1 m).
def lv95_to_wgs84(east: Column, north: Column) -> tuple[Column, Column]:
    y = (east - 2600000.0) / 1000000.0
    x = (north - 1200000.0) / 1000000.0
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = (
        16.9023892
        + 3.238272 * x
        - 0.270978 * y * y
        - 0.002528 * x * x
        - 0.0447 * y * y * x
        - 0.0140 * x * x * x
    )
    return lon * 100.0 / 36.0, lat * 100.0 / 36.0


def wgs84_to_lv95(lon: Column, lat: Column) -> tuple[Column, Column]:
    p = (lat * 3600.0 - 169028.66) / 10000.0
    q = (lon * 3600.0 - 26782.5) / 10000.0
    east = 2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p * p - 44.54 * q * q * q
    north = (
        1200147.07
        + 308807.95 * p
        + 3745.25 * q * q
        + 76.63 * p * p
        - 194.56 * q * q * p
        + 119.79 * p * p * p
    )
    return east, north


EARTH_RADIUS_M = 6371008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres between two lon/lat points in degrees."""
    s1 = F.sin(F.radians(lat2 - lat1) / 2.0)
    s2 = F.sin(F.radians(lon2 - lon1) / 2.0)
    h = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def between_open(value: Column, lo: float, hi: float) -> Column:
    return (value > lo) & (value < hi)
