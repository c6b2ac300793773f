"""Routes from a template track, and gate lines across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.functions.columns import rescale
from trackflow.functions.geometry import Line, between_open, distance, haversine, lv95_to_wgs84
from trackflow.operators.ordered import neighbours, running_total, seq_chunk, time_chunk
from trackflow.operators.tables import attach, materialise
from trackflow.operators.trajectory import MIN_STEP, cumulative_distance, moving, smooth, step_length

# The way runs between these two longitudes; start and end gates
# are 800 m long and look 3 vertices each way, measuring gates 100 m and 2.
LON_MIN, LON_MAX = 9.7895, 9.8000
END_GATE_LENGTH, END_GATE_REACH = 800.0, 3
GATE_LENGTH, GATE_REACH = 100.0, 2
MEASURING_GATES = 5


def lon(x: str = "x", y: str = "y") -> Column:
    return lv95_to_wgs84(F.col(x), F.col(y))[0]


def template_track(fixes: DataFrame, session: str, animal: str) -> DataFrame:
    return fixes.filter((F.col("session_id") == session) & (F.col("animal_id") == animal))


def numbered(points: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """Numbers the vertices of each route 0, 1, 2, ... along ``order``."""
    counted = running_total(points, ["route"], order, F.lit(1).cast("bigint"), chunk, "_count")
    return counted.withColumn("seq", F.col("_count") - 1).drop("_count")


def build_route(
    fixes: DataFrame, route: str, session: str, animal: str, hour_before: int, min_step: float = MIN_STEP
) -> DataFrame:
    """A smoothed polyline from one animal's walk: (route, seq, x, y).

    Steps are those of the whole track; the hour bound applies after.
    """
    track = step_length(template_track(fixes, session, animal))
    walked = moving(track.filter(F.col("hour") < hour_before), min_step)
    points = walked.select(F.lit(route).alias("route"), "time", "event_id", "x", "y")
    vertices = numbered(points, ["time", "event_id"], time_chunk()).select("route", "seq", "x", "y")
    return materialise(smooth(materialise(vertices), ["route"], ["x", "y"]))


def nearest_vertex(vertices: DataFrame, value: Column, targets: dict[int, Column]) -> DataFrame:
    """Per route and target: the vertex whose value is nearest, the first on ties.

    Returns (route, target_no, seq).
    """
    wanted = F.array(*[F.struct(F.lit(k).alias("no"), v.cast("double").alias("at")) for k, v in targets.items()])
    asked = vertices.select("route", "seq", value.alias("_v"), F.explode(wanted).alias("_t"))
    off = F.struct(F.abs(F.col("_v") - F.col("_t.at")), "seq")
    return asked.groupBy("route", F.col("_t.no").alias("target_no")).agg(F.min_by("seq", off).alias("seq"))


def perpendicular_lines(vertices: DataFrame, length: float, reach: int) -> DataFrame:
    """For every vertex the line across the route there; NULL within ``reach`` of an end.

    The route's direction is taken from the vertices ``reach`` before and after.
    """
    wanted = {"_ax": ("x", -reach), "_ay": ("y", -reach), "_bx": ("x", reach), "_by": ("y", reach)}
    near = neighbours(vertices, ["route"], ["seq"], wanted, seq_chunk())
    dx, dy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
    norm = F.sqrt(dx * dx + dy * dy)
    nx, ny = F.try_divide(-dy, norm) * (length / 2), F.try_divide(dx, norm) * (length / 2)
    return near.select(
        "route",
        "seq",
        (F.col("x") - nx).alias("x1"),
        (F.col("y") - ny).alias("y1"),
        (F.col("x") + nx).alias("x2"),
        (F.col("y") + ny).alias("y2"),
    )


def _gates_at(vertices: DataFrame, chosen: DataFrame, length: float, reach: int) -> DataFrame:
    lines = perpendicular_lines(vertices, length, reach)
    picked = attach(lines, materialise(chosen), ["route", "seq"], "inner")
    return picked.select("route", F.col("target_no").alias("gate_no"), "x1", "y1", "x2", "y2")


def start_end_gates(
    road: DataFrame,
    lons: tuple[float, float] = (LON_MIN, LON_MAX),
    gate_numbers: tuple[int, int] = (0, MEASURING_GATES + 1),
    length: float = END_GATE_LENGTH,
    reach: int = END_GATE_REACH,
) -> DataFrame:
    """The start and end gate across one route, at the vertices nearest two longitudes."""
    targets = {no: F.lit(at) for no, at in zip(gate_numbers, lons)}
    return _gates_at(road, nearest_vertex(road, lon(), targets), length, reach)


def clip_route(route: DataFrame, lo: float = LON_MIN, hi: float = LON_MAX) -> DataFrame:
    """The vertices strictly between two longitudes, numbered anew."""
    inside = route.filter(between_open(lon(), lo, hi))
    return numbered(inside.withColumnRenamed("seq", "_old"), ["_old"], seq_chunk("_old")).drop("_old")


def with_cumulative_distance(route: DataFrame) -> DataFrame:
    back = neighbours(route, ["route"], ["seq"], {"_px": ("x", -1), "_py": ("y", -1)}, seq_chunk())
    step = distance(F.col("_px"), F.col("_py"), F.col("x"), F.col("y"))
    walked = back.withColumn("step", step).drop("_px", "_py")
    return cumulative_distance(walked, ["route"], ["seq"], "step", seq_chunk())


def measuring_gates(
    route: DataFrame,
    n: int = MEASURING_GATES,
    length: float = GATE_LENGTH,
    reach: int = GATE_REACH,
    lo: float = LON_MIN,
    hi: float = LON_MAX,
) -> DataFrame:
    """``n`` gates that cut the clipped route into n + 1 about equal parts."""
    clipped = materialise(clip_route(route, lo, hi))
    walked = materialise(with_cumulative_distance(clipped))
    total = materialise(walked.groupBy("route").agg(F.max("cum_dist").alias("_total")))
    measured = attach(walked, total, ["route"])
    targets = {i: F.col("_total") * i / (n + 1) for i in range(1, n + 1)}
    return _gates_at(clipped, nearest_vertex(measured, F.col("cum_dist"), targets), length, reach)


def elevation_join(points: DataFrame, dem: DataFrame, cell: float) -> DataFrame:
    """Adds the elevation of the grid cell each point lies in (NULL outside the grid).

    Only the cells that hold a point are taken from the elevation grid.
    """
    at = {"cell_x": F.floor(F.col("x") / F.lit(cell)), "cell_y": F.floor(F.col("y") / F.lit(cell))}
    placed = points.withColumns(at)
    needed = materialise(placed.select("cell_x", "cell_y").distinct())
    known = materialise(attach(dem, needed, ["cell_x", "cell_y"], "left_semi"))
    return attach(placed, known, ["cell_x", "cell_y"]).drop("cell_x", "cell_y")


def elevation_profile(
    route: DataFrame, dem: DataFrame, cell: float, lo: float = LON_MIN, hi: float = LON_MAX, scale: float = MEASURING_GATES + 1
) -> DataFrame:
    """Elevation along the clipped route against the walked share, scaled to 0..gates."""
    clipped = materialise(clip_route(route, lo, hi))
    x_lon, y_lat = lv95_to_wgs84(F.col("x"), F.col("y"))
    degrees = clipped.withColumns({"lon": x_lon, "lat": y_lat})
    back = neighbours(degrees, ["route"], ["seq"], {"_lon": ("lon", -1), "_lat": ("lat", -1)}, seq_chunk())
    step = haversine(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat"))
    walked = back.withColumn("step", F.coalesce(step, F.lit(0.0))).drop("_lon", "_lat")
    summed = materialise(cumulative_distance(walked, ["route"], ["seq"], "step", seq_chunk()))
    scaled = rescale(summed, "cum_dist", 0.0, float(scale), ["route"], "gate_scale")
    return elevation_join(scaled, dem, cell).select("route", "seq", "elevation", "gate_scale")


def gate_lines(gates: DataFrame, *numbers: int) -> list[Line]:
    """The coordinates of the numbered gates, each of which all routes must share."""
    rows = gates.filter(F.col("gate_no").isin(list(numbers))).select("gate_no", "x1", "y1", "x2", "y2").collect()
    found: dict[int, set[Line]] = {no: set() for no in numbers}
    for row in rows:
        found[row["gate_no"]].add(Line(*row[1:]))
    odd = [no for no, lines in found.items() if len(lines) != 1]
    if odd:
        raise ValueError(f"gates {odd} must be one line each")
    return [next(iter(found[no])) for no in numbers]
