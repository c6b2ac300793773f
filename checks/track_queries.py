"""Trajectories, geometry, joins, ranking and trip aggregates."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from checks import data
from checks.registry import query
from checks.sqltext import GATE, OWN, dist, lat, lon, meets, point_line, secs
from trackflow.functions import columns as c
from trackflow.functions import geometry as g
from trackflow.operators import crossings, network, routes, snapshots, trajectory, trips
from trackflow.operators.ordered import neighbours, quantiles, seq_chunk, time_chunk
from trackflow.operators.tables import attach, materialise
from trackflow.sources.tracks import append_by_name

TRACK_WINDOW = "window w as (partition by session_id, animal_id order by time, event_id)"

# --- trajectories


@query(
    "d1_step_length",
    f"select event_id, {dist('x', 'y', 'nx', 'ny')} as steplength from (select *, lead(x) over w as nx, lead(y) over w as ny from tracks {TRACK_WINDOW})",
)
def d1(spark, sf_dir):
    return trajectory.step_length(data.tracks(spark, sf_dir)).select("event_id", "steplength")


@query("d2_segments", "select event_id, time2, x2, y2, timelag, steplength, speed from p1_c")
def d2(spark, sf_dir):
    good = trajectory.enough_satellites(data.tracks(spark, sf_dir))
    return trajectory.segments(good).select("event_id", "time2", "x2", "y2", "timelag", "steplength", "speed")


@query("d3_drop_speed_outliers", "select event_id, x2, y2, timelag, steplength, speed from segs")
def d3(spark, sf_dir):
    return data.study(spark, sf_dir).segments.select("event_id", "x2", "y2", "timelag", "steplength", "speed")


def template(spark, sf_dir):
    """Every animal's walk of each session as a route with numbered vertices."""
    points = data.tracks(spark, sf_dir).select(F.concat_ws("/", "session_id", "animal_id").alias("route"), "time", "event_id", "x", "y")
    return materialise(routes.numbered(points, ["time", "event_id"], time_chunk()).select("route", "seq", "x", "y"))


TEMPLATE = """(select session_id || '/' || animal_id as route, row_number() over w - 1 as seq, x, y from tracks
  window w as (partition by session_id, animal_id order by time, event_id))"""
ROUTE_WINDOW = "window w as (partition by route order by seq)"
SMOOTHED = f"""(select route, seq, case when px is null then (x + nx + nnx) / 3 when nx is null then (ppx + px + x) / 3 else (px + x + nx) / 3 end as x,
  case when px is null then (y + ny + nny) / 3 when nx is null then (ppy + py + y) / 3 else (py + y + ny) / 3 end as y
  from (select *, lag(x) over w as px, lead(x) over w as nx, lag(x, 2) over w as ppx, lead(x, 2) over w as nnx,
    lag(y) over w as py, lead(y) over w as ny, lag(y, 2) over w as ppy, lead(y, 2) over w as nny from {TEMPLATE} {ROUTE_WINDOW}))"""


@query("d4_smooth", f"select route, seq, x, y from {SMOOTHED}")
def d4(spark, sf_dir):
    return trajectory.smooth(template(spark, sf_dir), ["route"], ["x", "y"])


CUMULATED = f"""(select route, seq, x, y, sum(coalesce(step, 0)) over (partition by route order by seq) as cum from
  (select *, {dist('px', 'py', 'x', 'y')} as step from (select *, lag(x) over w as px, lag(y) over w as py from {TEMPLATE} {ROUTE_WINDOW})))"""


@query("d5_cumulative_distance", f"select route, seq, round(cum, 4) as cum_dist from {CUMULATED}")
def d5(spark, sf_dir):
    walked = routes.with_cumulative_distance(template(spark, sf_dir))
    return walked.select("route", "seq", F.round("cum_dist", 4).alias("cum_dist"))


@query(
    "d6_nearest_vertex",
    f"""select route, target_no, seq from (select route, no as target_no, seq,
      row_number() over (partition by route, no order by abs(x - goal), seq) as rn
      from {TEMPLATE}, (values (1, 2780400.0::double), (2, 2780900.0::double)) t(no, goal)) where rn = 1""",
)
def d6(spark, sf_dir):
    targets = {1: F.lit(2780400.0), 2: F.lit(2780900.0)}
    return routes.nearest_vertex(template(spark, sf_dir), F.col("x"), targets)


@query("d7_trip_events", "select event_id, cs as crosses_start, ce as crosses_end, out_start, back_start, out_end, back_end from ev")
def d7(spark, sf_dir):
    return data.study(spark, sf_dir).events.select(
        "event_id", "crosses_start", "crosses_end", "out_start", "back_start", "out_end", "back_end"
    )


@query("d8_position_at", "select session_id, direction, gate_no, animal_id, share, px, py from pos")
def d8(spark, sf_dir):
    return data.study(spark, sf_dir).positions.select("session_id", "direction", "gate_no", "animal_id", "share", "px", "py")


@query("d9_crossing_time", "select event_id, gate_no, share, crossing_time from hits")
def d9(spark, sf_dir):
    study = data.study(spark, sf_dir)
    return crossings.all_crossings(study.trips, study.setting.gates).select("event_id", "gate_no", "share", "crossing_time")


# --- geometry

# A walk that serves as template: the session and animal with the most fixes
# are not known beforehand, so a whole study day of one animal is one route.
DAY_ROUTE = """(select 'day' as route, row_number() over (order by time, event_id) - 1 as seq, x, y from
  (select *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) as steplength from (select *, lead(x) over w as nx, lead(y) over w as ny
    from tracks where session_id = '01-03-M' and animal_id = 'HO01' window w as (partition by session_id, animal_id order by time, event_id)))
  where hour < 6 and (steplength is null or steplength > 5))"""


def smoothed_sql(source: str) -> str:
    return SMOOTHED.replace(TEMPLATE, source)


@query("e1_build_route", f"select route, seq, x, y from {smoothed_sql(DAY_ROUTE)}")
def e1(spark, sf_dir):
    return routes.build_route(data.tracks(spark, sf_dir), "day", "01-03-M", "HO01", 6)


def across_sql(source: str, length: float, reach: int) -> str:
    dx, dy = "(bx - ax)", "(by_ - ay)"
    norm = f"sqrt({dx} * {dx} + {dy} * {dy})"
    nx, ny = f"(-{dy} / nullif({norm}, 0) * {length / 2}::double)", f"({dx} / nullif({norm}, 0) * {length / 2}::double)"
    return f"""(select route, seq, x - {nx} as x1, y - {ny} as y1, x + {nx} as x2, y + {ny} as y2 from
      (select *, lag(x, {reach}) over w as ax, lag(y, {reach}) over w as ay, lead(x, {reach}) over w as bx, lead(y, {reach}) over w as by_
       from {source} {ROUTE_WINDOW}))"""


@query("e2_perpendicular_line", f"select route, seq, x1, y1, x2, y2 from {across_sql(TEMPLATE, 100.0, 2)}")
def e2(spark, sf_dir):
    return routes.perpendicular_lines(template(spark, sf_dir), 100.0, 2)


@query(
    "e3_start_end_gates",
    f"""select g.route, cast(n.no as int) as gate_no, x1, y1, x2, y2 from {across_sql(TEMPLATE, 800.0, 3)} g join
      (select route, no, seq from (select route, no, seq, row_number() over (partition by route, no order by abs({lon('x', 'y')} - goal), seq) as rn
        from {TEMPLATE}, (values (0, 9.7895::double), (6, 9.8::double)) t(no, goal)) where rn = 1) n on n.route = g.route and n.seq = g.seq""",
)
def e3(spark, sf_dir):
    return routes.start_end_gates(template(spark, sf_dir))


CLIPPED = f"""(select route, row_number() over (partition by route order by seq) - 1 as seq, x, y from {TEMPLATE}
  where {lon('x', 'y')} > 9.7895 and {lon('x', 'y')} < 9.8)"""


@query(
    "e4_measuring_gates",
    f"""select g.route, cast(n.no as int) as gate_no, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2
      from {across_sql(CLIPPED, 100.0, 2)} g join
      (select route, no, seq from (select route, no, seq,
          row_number() over (partition by route, no order by abs(cum - total * no / 6.0::double), seq) as rn
        from (select *, max(cum) over (partition by route) as total from {CUMULATED.replace(TEMPLATE, CLIPPED)}),
          (values (1), (2), (3), (4), (5)) t(no)) where rn = 1) n on n.route = g.route and n.seq = g.seq""",
)
def e4(spark, sf_dir):
    gates = routes.measuring_gates(template(spark, sf_dir))
    return gates.select("route", "gate_no", *[F.round(k, 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("e5_segment_meets_gate", f"select event_id, s.route, gate_no from (select t.*, r.route from segs t, (values ('trail'), ('road')) r(route)) s join gates g on g.route = s.route where {meets(OWN, GATE)}")
def e5(spark, sf_dir):
    study = data.study(spark, sf_dir)
    both = study.segments.withColumn("route", F.explode(F.array(F.lit("trail"), F.lit("road"))))
    return crossings.all_crossings(both, study.setting.gates).select("event_id", "route", "gate_no")


@query("e6_intersection_point", "select event_id, gate_no, cut_x, cut_y from hits")
def e6(spark, sf_dir):
    study = data.study(spark, sf_dir)
    return crossings.all_crossings(study.trips, study.setting.gates).select("event_id", "gate_no", "cut_x", "cut_y")


REF_X, REF_Y = 2780425.0, 1161875.0


@query("e7_point_distance", f"select event_id, {dist('x', 'y', f'{REF_X}::double', f'{REF_Y}::double')} as dist_to_ref from tracks")
def e7(spark, sf_dir):
    far = g.distance(F.col("x"), F.col("y"), F.lit(REF_X), F.lit(REF_Y))
    return data.tracks(spark, sf_dir).select("event_id", far.alias("dist_to_ref"))


@query(
    "e8_point_polyline_distance",
    f"select event_id, route, min({point_line('x', 'y', 'x1', 'y1', 'w.x2', 'w.y2')}) as dist from (select event_id, x, y from tracks) t, ways w group by all",
)
def e8(spark, sf_dir):
    return trips.route_distances(data.tracks(spark, sf_dir), data.routes(spark), ["trail", "road"], ["event_id"])


@query(
    "e9_point_gate_distance",
    f"select event_id, {point_line('x', 'y', '2780300::double', '1160900::double', '2780310::double', '1161200::double')} as dist from tracks",
)
def e9(spark, sf_dir):
    line = g.Line(2780300, 1160900, 2780310, 1161200)
    return data.tracks(spark, sf_dir).select("event_id", g.point_segment_distance(F.col("x"), F.col("y"), line).alias("dist"))


@query("e10_within_distance", "select session_id, direction, gate_no, a, b, dist from near")
def e10(spark, sf_dir):
    return network.near_pairs(data.study(spark, sf_dir).positions)


@query("e11_lon_lat", f"select event_id, {lon('x', 'y')} as lon, {lat('x', 'y')} as lat from tracks")
def e11(spark, sf_dir):
    x_lon, y_lat = g.lv95_to_wgs84(F.col("x"), F.col("y"))
    return data.tracks(spark, sf_dir).select("event_id", x_lon.alias("lon"), y_lat.alias("lat"))


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"2 * 6371008.8 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"
    )


@query(
    "e12_geodesic_step",
    f"select route, seq, round({haversine_sql('lo', 'la', 'lon', 'lat')}, 4) as step from (select *, lag(lon) over w as lo, lag(lat) over w as la"
    f" from (select route, seq, {lon('x', 'y')} as lon, {lat('x', 'y')} as lat from {TEMPLATE}) {ROUTE_WINDOW})",
)
def e12(spark, sf_dir):
    x_lon, y_lat = g.lv95_to_wgs84(F.col("x"), F.col("y"))
    points = template(spark, sf_dir).withColumns({"lon": x_lon, "lat": y_lat})
    back = neighbours(points, ["route"], ["seq"], {"lo": ("lon", -1), "la": ("lat", -1)}, seq_chunk())
    step = g.haversine(F.col("lo"), F.col("la"), F.col("lon"), F.col("lat"))
    return back.select("route", "seq", F.round(step, 4).alias("step"))


PROFILE_STEPS = f"""(select route, seq, x, y, sum(coalesce(step, 0)) over (partition by route order by seq) as cum from (
  select *, {haversine_sql('lo', 'la', 'lon', 'lat')} as step from (select *, lag(lon) over w as lo, lag(lat) over w as la
  from (select *, {lon('x', 'y')} as lon, {lat('x', 'y')} as lat from {CLIPPED}) {ROUTE_WINDOW})))"""


@query(
    "a6_elevation_profile",
    f"""select p.route, p.seq, d.elevation, round(coalesce((cum - lo) / nullif(hi - lo, 0), 0.5) * 6.0, 4) as gate_scale from
      (select *, min(cum) over (partition by route) as lo, max(cum) over (partition by route) as hi from {PROFILE_STEPS}) p
      left join (select floor(x / 25.0::double) as cx, floor(y / 25.0::double) as cy, 2000.0::double + max(nsat) + min(hour) / 4.0 as elevation
        from tracks where y < 1161030 group by all) d on d.cx = floor(p.x / 25.0::double) and d.cy = floor(p.y / 25.0::double)""",
)
def a6_profile(spark, sf_dir):
    from checks.scalar_queries import dem

    profile = routes.elevation_profile(template(spark, sf_dir), dem(spark, sf_dir, 25.0), 25.0)
    return profile.withColumn("gate_scale", F.round("gate_scale", 4))


# --- joins


@query("f1_fixes_with_windows", "select event_id, out_from, back_to from segs left join win using (session_id)")
def f1(spark, sf_dir):
    study = data.study(spark, sf_dir)
    return attach(study.segments, study.windows, ["session_id"]).select("event_id", "out_from", "back_to")


@query("f2_complete_trips_only", "select event_id, direction from trips0")
def f2(spark, sf_dir):
    study = data.study(spark, sf_dir)
    labelled = trips.label_trips(study.segments, study.windows)
    return trips.keep_complete(labelled, study.complete).select("event_id", "direction")


@query("f3_route_of_trip", "select event_id, direction, route from trips")
def f3(spark, sf_dir):
    return data.study(spark, sf_dir).trips.select("event_id", "direction", "route")


@query("f4_crossings", "select session_id, animal_id, direction, route, gate_no, crossing_time, breed, day_part from cr")
def f4(spark, sf_dir):
    return data.study(spark, sf_dir).crossings


@query("f5_asof_last", "select session_id, direction, gate_no, ref_time, animal_id, event_id, time from last_fix")
def f5(spark, sf_dir):
    study = data.study(spark, sf_dir)
    fixes = study.trips.select("session_id", "direction", "animal_id", "event_id", "time")
    refs = study.leaders.drop("leader_id")
    return snapshots.asof_last(fixes, refs, ["session_id", "direction"], ["animal_id"])


NEAREST = f"""(select l.session_id, l.direction, l.gate_no, l.ref_time, t.animal_id, t.event_id, t.time, abs({secs('t.time', 'l.ref_time')}) as diff_s
  from lead_at l join trips t on t.session_id = l.session_id and t.direction = l.direction)"""


@query(
    "f6_asof_nearest",
    f"select * exclude (rk) from (select *, rank() over (partition by session_id, direction, gate_no, animal_id order by diff_s) as rk from {NEAREST}) where rk = 1",
)
def f6(spark, sf_dir):
    study = data.study(spark, sf_dir)
    fixes = study.trips.select("session_id", "direction", "animal_id", "event_id", "time")
    return snapshots.asof_nearest(fixes, study.leaders.drop("leader_id"), ["session_id", "direction"], ["animal_id"])


@query(
    "f6_asof_nearest_first",
    f"""select * exclude (rn) from (select *, row_number() over (partition by session_id, direction, gate_no, animal_id order by diff_s, time, event_id) as rn
      from {NEAREST}) where rn = 1""",
)
def f6_first(spark, sf_dir):
    study = data.study(spark, sf_dir)
    fixes = study.trips.select("session_id", "direction", "animal_id", "event_id", "time")
    return snapshots.asof_nearest(fixes, study.leaders.drop("leader_id"), ["session_id", "direction"], ["animal_id"], ties=False)


@query(
    "f6_nearest_to_moment",
    """select animal_id, event_id, diff_s from (select *, rank() over (partition by animal_id order by diff_s) as rk from
      (select *, abs(epoch_us(time) - epoch_us(timestamp '2024-01-07 05:10:00')) / 1e6 as diff_s from tracks)) where rk = 1""",
)
def f6_moment(spark, sf_dir):
    """One moment, every animal's nearest fixes over all sessions."""
    fixes = data.tracks(spark, sf_dir).select(F.lit("all").alias("study"), "animal_id", "event_id", "time")
    at = datetime.datetime(2024, 1, 7, 5, 10, tzinfo=datetime.timezone.utc)
    refs = spark.range(1).select(F.lit("all").alias("study"), F.lit(at).cast("timestamp").alias("ref_time"))
    return snapshots.asof_nearest(fixes, refs, ["study"], ["animal_id"]).select("animal_id", "event_id", "diff_s")


# --- trip aggregates


@query("g1_session_windows", "select session_id, out_from, out_to, back_from, back_to from win")
def g1(spark, sf_dir):
    return data.study(spark, sf_dir).windows


@query("g2_complete_flags", "select session_id, animal_id, out_complete, back_complete from whole")
def g2(spark, sf_dir):
    return data.study(spark, sf_dir).complete


@query(
    "g3_assign_route",
    "select session_id, direction, round(mean_dist_trail, 4) as mean_dist_trail, round(mean_dist_road, 4) as mean_dist_road, route from assigned",
)
def g3(spark, sf_dir):
    rounded = {k: F.round(k, 4) for k in ("mean_dist_trail", "mean_dist_road")}
    return data.study(spark, sf_dir).assigned.withColumns(rounded)


SUMMARY = "round(avg(rank), 4) as mean_rank, round(avg(gap), 4) as mean_gap"


def rounded_summary(df):
    return df.withColumns({k: F.round(k, 4) for k in ("mean_rank", "mean_gap")})


@query("g4_gap_summary", f"select route, animal_id, gate_no, direction, {SUMMARY} from ranked group by all")
def g4(spark, sf_dir):
    return rounded_summary(data.study(spark, sf_dir).gap_summary())


@query("g5_gap_summary_by_day_part", f"select route, animal_id, gate_no, day_part, direction, {SUMMARY} from ranked group by all")
def g5(spark, sf_dir):
    ranked = data.study(spark, sf_dir).ranked
    return rounded_summary(crossings.gap_summary(ranked, ["route", "animal_id", "gate_no", "day_part", "direction"]))


@query("g6_mean_rank_by_animal", "select animal_id, breed, round(avg(rank), 4) as mean_rank from ranked group by all")
def g6(spark, sf_dir):
    means = crossings.mean_rank_by_animal(data.study(spark, sf_dir).ranked)
    return means.withColumn("mean_rank", F.round("mean_rank", 4)).orderBy("mean_rank")


DURATION = "(select source_file, source_layer, (epoch_us(max(time)) - epoch_us(min(time))) / 60e6 as duration_min from (select *, try_strptime(time_text, '%Y-%m-%d %H:%M:%S') as time from raw) group by all)"


@query("g7_trip_duration", f"select source_file, source_layer, duration_min from {DURATION}")
def g7(spark, sf_dir):
    fixes = c.parse_source_columns(data.raw_fixes(spark, sf_dir))
    return trips.trip_duration(fixes, ["source_file", "source_layer"])


@query("g7_mean_trip_duration", f"select round(avg(duration_min), 4) as mean_min from {DURATION}")
def g7_mean(spark, sf_dir):
    return g7(spark, sf_dir).agg(F.round(F.avg("duration_min"), 4).alias("mean_min"))


@query(
    "g8_distinct_counts",
    "select nullif(regexp_extract(source_file, '(R1|R2|R3)', 1), '') as period, count(distinct source_file) as files, count(distinct source_layer) as slices, count(*) as fixes from raw group by 1",
)
def g8(spark, sf_dir):
    fixes = c.parse_source_columns(data.raw_fixes(spark, sf_dir))
    # Count each file and slice once per task before the distinct shuffle.
    counted = fixes.groupBy("period", "source_file", "source_layer").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("period").agg(
        F.countDistinct("source_file").alias("files"), F.countDistinct("source_layer").alias("slices"), F.sum("n").alias("fixes")
    )


@query("g8_distinct_animals", "select distinct animal_id from tracks")
def g8_animals(spark, sf_dir):
    return data.tracks(spark, sf_dir).select("animal_id").distinct()


@query("g13_extremes", "select min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max from tracks")
def g13(spark, sf_dir):
    ends = {f"{k}_{n}": f(k) for k in ("x", "y") for n, f in (("min", F.min), ("max", F.max))}
    return data.tracks(spark, sf_dir).agg(*[v.alias(k) for k, v in ends.items()])


# --- ranking


@query("h1_mid_rank", "select route, session_id, direction, gate_no, animal_id, rank from ranked")
def h1(spark, sf_dir):
    return data.study(spark, sf_dir).ranked.select("route", "session_id", "direction", "gate_no", "animal_id", "rank")


@query("h1_mid_rank_without_route", "select session_id, direction, gate_no, animal_id, rank from arrival")
def h1_plain(spark, sf_dir):
    arrival = crossings.rank_at_gates(data.study(spark, sf_dir).crossings, ["session_id", "direction", "gate_no"])
    return arrival.select("session_id", "direction", "gate_no", "animal_id", "rank")


@query("h2_gap_to_leader", "select route, session_id, direction, gate_no, animal_id, gap from ranked")
def h2(spark, sf_dir):
    return data.study(spark, sf_dir).ranked.select("route", "session_id", "direction", "gate_no", "animal_id", "gap")


LINES = "(values (1, 2780300::double, 1160900::double, 2780310::double, 1161200::double), (2, 2781000::double, 1160900::double, 2780990::double, 1161200::double)) l(gate_no, x1, y1, x2, y2)"
CLOSEST = f"""(select * exclude (rk) from (select *, rank() over (partition by animal_id, session_id, gate_no order by dist) as rk from
  (select t.*, cast(l.gate_no as int) as gate_no, {point_line('x', 'y', 'l.x1', 'l.y1', 'l.x2', 'l.y2')} as dist from tracks t, {LINES})) where rk = 1)"""


def closest(spark, sf_dir):
    lines = spark.range(1, 3).select(
        F.col("id").cast("int").alias("gate_no"),
        F.when(F.col("id") == 1, 2780300.0).otherwise(2781000.0).alias("x1"),
        F.lit(1160900.0).alias("y1"),
        F.when(F.col("id") == 1, 2780310.0).otherwise(2780990.0).alias("x2"),
        F.lit(1161200.0).alias("y2"),
    )
    fixes = data.tracks(spark, sf_dir).select("event_id", "animal_id", "session_id", "time", "x", "y")
    return crossings.nearest_to_gate(fixes, lines, ["animal_id", "session_id"])


@query("h7_nearest_to_gate", f"select event_id, animal_id, session_id, gate_no, dist from {CLOSEST}")
def h7(spark, sf_dir):
    return closest(spark, sf_dir).select("event_id", "animal_id", "session_id", "gate_no", "dist")


@query(
    "h3_order_by_time_of_day",
    f"""select event_id, session_id, gate_no, cast(row_number() over (partition by session_id, gate_no order by strftime(time, '%H:%M:%S'), event_id) as int) as rank
      from {CLOSEST}""",
)
def h3(spark, sf_dir):
    near = closest(spark, sf_dir).withColumn("time_of_day", c.time_of_day(F.col("time")))
    return crossings.order_at_gate(near, ["session_id", "gate_no"]).select("event_id", "session_id", "gate_no", "rank")


@query("h4_first_crossing", "select session_id, animal_id, direction, gate_no, min(crossing_time) as crossing_time from hits group by all")
def h4(spark, sf_dir):
    study = data.study(spark, sf_dir)
    hits = crossings.all_crossings(study.trips, study.setting.gates)
    return crossings.first_crossings(hits).select("session_id", "animal_id", "direction", "gate_no", "crossing_time")


@query("h5_leader_at_gate", "select session_id, direction, gate_no, ref_time, leader_id from lead_at")
def h5(spark, sf_dir):
    return data.study(spark, sf_dir).leaders


@query(
    "h6_latest_fix",
    f"select session_id, animal_id, event_id, time from (select *, row_number() over (partition by session_id, animal_id order by time desc, event_id) as rn from tracks) where rn = 1",
)
def h6(spark, sf_dir):
    fixes = data.tracks(spark, sf_dir)
    latest = F.max_by(F.struct("event_id", "time"), F.struct("time", -F.col("event_id"))).alias("f")
    return fixes.groupBy("session_id", "animal_id").agg(latest).select("session_id", "animal_id", "f.*")


@query(
    "h8_rank_profile",
    "select animal_id, gate_no, rank, gap from ranked where session_id = '01-05-A' and direction = 'out'",
)
def h8(spark, sf_dir):
    study = data.study(spark, sf_dir)
    one = study.crossings.filter((F.col("session_id") == "01-05-A") & (F.col("direction") == "out"))
    return crossings.rank_at_gates(one).select("animal_id", "gate_no", "rank", "gap")


@query("h9_sorted_fixes", "select session_id, animal_id, time, event_id from tracks")
def h9(spark, sf_dir):
    return data.tracks(spark, sf_dir).select("session_id", "animal_id", "time", "event_id").orderBy("session_id", "animal_id", "time", "event_id")


@query("h10_farthest_fix", f"select animal_id, min(event_id) filter (d = m) as event_id from (select *, max(d) over (partition by animal_id) as m from (select animal_id, event_id, {dist('x', 'y', f'{REF_X}::double', f'{REF_Y}::double')} as d from tracks)) group by animal_id")
def h10(spark, sf_dir):
    far = e7(spark, sf_dir).join(data.tracks(spark, sf_dir).select("event_id", "animal_id"), "event_id")
    best = F.max_by("event_id", F.struct(F.col("dist_to_ref"), -F.col("event_id")))
    return far.groupBy("animal_id").agg(best.alias("event_id"))


@query(
    "h11_display_order",
    """select animal_id, breed, cast(case when place <= ceil(size / 2.0) then 2 * place - 1 else 2 * (place - ceil(size / 2.0)) end as int) as shade from (
      select animal_id, breed, row_number() over (partition by breed order by mean_rank, animal_id) as place, count(*) over (partition by breed) as size
      from (select animal_id, breed, round(avg(rank), 6) as mean_rank from ranked group by all))""",
)
def h11(spark, sf_dir):
    means = crossings.mean_rank_by_animal(data.study(spark, sf_dir).ranked)
    means = means.withColumn("mean_rank", F.round("mean_rank", 6))
    return crossings.display_order(means).select("animal_id", "breed", "shade")
