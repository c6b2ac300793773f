"""Sources, scalar columns and filters."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from checks import data
from checks.registry import query
from checks.sqltext import dist, lon, rounded_time, secs
from trackflow.functions import columns as c
from trackflow.functions.geometry import between_open
from trackflow.operators import crossings, routes, trajectory, trips
from trackflow.operators.network import matrix_to_pairs, pair_matrix
from trackflow.operators.tables import materialise, working_dir
from trackflow.sources import sinks
from trackflow.sources.tracks import append_by_name, read_gates, read_tracks

# --- sources and sinks


@query(
    "a2_provenance",
    "select event_id, 'events.parquet' as source_file, event_type from events",
)
def a2(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_tracks(spark, f"{sf_dir}/events.parquet", "parquet").select("event_id", "source_file", "event_type")


@query(
    "a3_read_gates",
    "select session_id as route, cast(0 as int) as gate_no, min(x) as x1, min(y) as y1, min(x) as x2, max(y) as y2 from tracks group by session_id"
    " union all select session_id, 1, max(x), min(y), max(x), max(y) from tracks group by session_id",
)
def a3(spark, sf_dir):
    """Gate lines at both ends of every session's extent, written and read back."""
    ends = data.tracks(spark, sf_dir).groupBy(F.col("session_id").alias("route")).agg(
        *[f("x").alias(f"x_{n}") for n, f in (("lo", F.min), ("hi", F.max))],
        *[f("y").alias(f"y_{n}") for n, f in (("lo", F.min), ("hi", F.max))],
    )
    sides = F.array(*[F.struct(F.lit(no).alias("gate_no"), F.col(x).alias("x")) for no, x in ((0, "x_lo"), (1, "x_hi"))])
    lines = ends.withColumn("s", F.explode(sides)).select(
        "route", "s.gate_no", F.col("s.x").alias("x1"), F.col("y_lo").alias("y1"), F.col("s.x").alias("x2"), F.col("y_hi").alias("y2")
    )
    path = f"{working_dir(spark)}/gates"
    sinks.write_layers({"drawn": lines}, path)
    return read_gates(spark, f"{path}/drawn")


@query(
    "a4_write_layers",
    "select 'crossings' as layer, count(*) as n from cr union all select 'windows', count(*) from win"
    " union all select 'trips', count(*) from trips",
)
def a4(spark, sf_dir):
    study = data.study(spark, sf_dir)
    path = f"{working_dir(spark)}/layers"
    layers = {"crossings": study.crossings, "windows": study.windows, "trips": study.trips}
    sinks.write_layers(layers, path)
    back = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("layer")) for name in layers]
    return append_by_name(back).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a5_write_csv",
    "select animal_id as x, coalesce((select sum(n) from prox where a = animal_id or b = animal_id), 0)::bigint as meetings from herd",
)
def a5(spark, sf_dir):
    """Column sums of the proximity matrix after a way through CSV."""
    study = data.study(spark, sf_dir)
    path = f"{working_dir(spark)}/csv"
    sinks.write_csv({"dist_matrix": pair_matrix(study.proximity, study.animals), "animals": study.animals}, path)
    matrix = spark.read.csv(f"{path}/dist_matrix", header=True, inferSchema=True)
    names = spark.read.csv(f"{path}/animals", header=True)
    long = matrix.unpivot([], matrix.columns, "x", "n").groupBy("x").agg(F.sum("n").alias("meetings"))
    return names.join(long, names["animal_id"] == long["x"]).select("x", F.col("meetings").cast("bigint").alias("meetings"))


def dem(spark, sf_dir, cell: float):
    """An elevation grid over the part of the field where some fixes lie."""
    at = [F.floor(F.col(k) / F.lit(cell)).alias(f"cell_{k}") for k in ("x", "y")]
    known = data.tracks(spark, sf_dir).filter(F.col("y") < 1161030).groupBy(*at)
    return known.agg((F.lit(2000.0) + F.max("nsat") + F.min("hour") / F.lit(4.0)).alias("elevation"))


DEM = (
    "select floor(x / 25.0::double) as cx, floor(y / 25.0::double) as cy, 2000.0::double + max(nsat) + min(hour) / 4.0 as elevation"
    " from tracks where y < 1161030 group by all"
)


@query(
    "a6_elevation_join",
    f"select t.event_id, d.elevation from tracks t left join ({DEM}) d on d.cx = floor(t.x / 25.0::double) and d.cy = floor(t.y / 25.0::double)",
)
def a6(spark, sf_dir):
    points = data.tracks(spark, sf_dir).select("event_id", "x", "y")
    return routes.elevation_join(points, dem(spark, sf_dir, 25.0), 25.0).select("event_id", "elevation")


# --- scalar columns


def raw_column(name: str, column, sql: str, out: str) -> None:
    @query(name, f"select event_id, {sql} as {out} from raw")
    def run(spark, sf_dir):
        return data.raw_fixes(spark, sf_dir).select("event_id", column().alias(out))


FILE, LAYER = (lambda: F.col("source_file")), (lambda: F.col("source_layer"))
raw_column("b1_parse_time", lambda: c.parse_time(F.col("time_text")), "try_strptime(time_text, '%Y-%m-%d %H:%M:%S')", "time")
raw_column("b2_breed_from_file", lambda: c.breed_from_file(FILE()), "nullif(regexp_extract(source_file, '-([A-Z][A-Z])', 1), '')", "breed")
raw_column("b3_number_from_file", lambda: c.number_from_file(FILE()), "nullif(regexp_extract(source_file, '([0-9][0-9])[.]gpkg', 1), '')", "number")
raw_column("b4_animal_from_file", lambda: c.animal_from_file(FILE()), r"case when source_file like '%-%.gpkg' then replace(split_part(source_file, '-', 2), '.gpkg', '') end", "animal_id")
raw_column("b5_time_of_day", lambda: c.time_of_day(c.parse_time(F.col("time_text"))), "strftime(try_strptime(time_text, '%Y-%m-%d %H:%M:%S'), '%H:%M:%S')", "time_of_day")
raw_column("b6_study_group", lambda: c.study_group(FILE()), "left(source_file, 2)", "study_group")
raw_column("b7_day_part", lambda: c.day_part(LAYER()), "substring(source_layer, 7, 1)", "day_part")
raw_column("b8_period", lambda: c.period(FILE()), "nullif(regexp_extract(source_file, '(R1|R2|R3)', 1), '')", "period")
raw_column("b19_text_tests", lambda: F.concat_ws(",", F.trim(F.concat(F.lit("  "), FILE(), F.lit(" "))), FILE().rlike("^R[12]").cast("string"), LAYER().endswith("lns").cast("string"), FILE().contains("HO").cast("string")), "concat_ws(',', trim('  ' || source_file || ' '), cast(regexp_matches(source_file, '^R[12]') as varchar), cast(ends_with(source_layer, 'lns') as varchar), cast(contains(source_file, 'HO') as varchar))", "tests")


@query("b9_breed_from_animal", "select event_id, breed as breed from tracks")
def b9(spark, sf_dir):
    return data.tracks(spark, sf_dir).select("event_id", c.breed_from_animal(F.col("animal_id")).alias("breed"))


@query("b10_point_coordinates", "select event_id, x, y from tracks")
def b10(spark, sf_dir):
    return data.tracks(spark, sf_dir).select("event_id", "x", "y")


@query("b11_gate_name_to_number", "select session_id, animal_id, direction, route, cast(cast(gate_no as varchar) as int) + 1 as next_gate from cr")
def b11(spark, sf_dir):
    named = data.study(spark, sf_dir).crossings.withColumn("gate", F.col("gate_no").cast("string"))
    return named.select("session_id", "animal_id", "direction", "route", (F.col("gate").cast("int") + 1).alias("next_gate"))


@query("b12_seconds_between", "select event_id, timelag from segs")
def b12(spark, sf_dir):
    return data.study(spark, sf_dir).segments.select("event_id", c.seconds_between(F.col("time"), F.col("time2")).alias("timelag"))


@query("b13_shift_time", "select session_id, out_from - interval 2 minute as early, out_to + interval 2 minute as late from win")
def b13(spark, sf_dir):
    w = data.study(spark, sf_dir).windows
    return w.select("session_id", c.shift_seconds(F.col("out_from"), -120).alias("early"), c.shift_seconds(F.col("out_to"), 120).alias("late"))


@query("b14_direction_label", "select event_id, direction from labelled")
def b14(spark, sf_dir):
    study = data.study(spark, sf_dir)
    return trips.label_trips(study.segments, study.windows).select("event_id", "direction")


@query("b15_replace_null", "select event_id, coalesce(steplength, 0) as step from segs")
def b15(spark, sf_dir):
    return data.study(spark, sf_dir).segments.select("event_id", F.coalesce("steplength", F.lit(0.0)).alias("step"))


@query(
    "b16_rescale",
    "select event_id, (x - min(x) over s) / (max(x) over s - min(x) over s) * 6.0::double + 0.0::double as scaled from tracks window s as (partition by session_id)",
)
def b16(spark, sf_dir):
    fixes = data.tracks(spark, sf_dir).select("event_id", "session_id", "x")
    return c.rescale(fixes, "x", 0.0, 6.0, ["session_id"], "scaled").select("event_id", "scaled")


@query("b17_round_to_second", f"select event_id, {rounded_time('epoch_us(ts) / 1e6')} as time from events")
def b17(spark, sf_dir):
    return data.events(spark, sf_dir).select("event_id", c.round_to_second(c.epoch_seconds(F.col("ts"))).alias("time"))


@query("b18_time_distance", "select event_id, abs((epoch_us(timestamp '2024-01-15 05:10:00') - epoch_us(time)) / 1e6) as diff_s from tracks")
def b18(spark, sf_dir):
    at = F.lit(datetime.datetime(2024, 1, 15, 5, 10, tzinfo=datetime.timezone.utc)).cast("timestamp")
    return data.tracks(spark, sf_dir).select("event_id", F.abs(c.seconds_between(F.col("time"), at)).alias("diff_s"))


@query("b20_select_drop_rename", "select event_id, animal_id as name, direction as way, route from trips")
def b20(spark, sf_dir):
    t = data.study(spark, sf_dir).trips.drop("x2", "y2", "time2", "timelag", "steplength", "speed")
    return t.withColumnsRenamed({"animal_id": "name", "direction": "way"}).select("event_id", "name", "way", "route")


@query(
    "b21_rank_reversal",
    "select session_id, direction, gate_no, animal_id, (select max(rank) from arrival) + 1 - rank as reversed from arrival",
)
def b21(spark, sf_dir):
    from trackflow.operators.stats import reversed_rank

    arrival = crossings.rank_at_gates(data.study(spark, sf_dir).crossings, ["session_id", "direction", "gate_no"])
    return reversed_rank(arrival, "rank", "reversed").select("session_id", "direction", "gate_no", "animal_id", "reversed")


# --- filters


def parsed(spark, sf_dir):
    return c.parse_source_columns(data.raw_fixes(spark, sf_dir))


@query("c1_drop_auxiliary", "select event_id, source_layer as session_id from raw where not ends_with(source_layer, 'lns')")
def c1(spark, sf_dir):
    return trajectory.drop_auxiliary(parsed(spark, sf_dir)).select("event_id", "session_id")


@query("c2_drop_session", "select event_id, session_id from tracks where session_id <> '01-14-M'")
def c2(spark, sf_dir):
    return trajectory.drop_sessions(data.tracks(spark, sf_dir), ["01-14-M"]).select("event_id", "session_id")


@query("c3_select_study_group", "select event_id, source_file from raw where left(source_file, 2) = 'R3'")
def c3(spark, sf_dir):
    return parsed(spark, sf_dir).filter(F.col("study_group") == "R3").select("event_id", "source_file")


@query("c4_enough_satellites", "select event_id, nsat from tracks where nsat >= 4")
def c4(spark, sf_dir):
    return trajectory.enough_satellites(data.tracks(spark, sf_dir)).select("event_id", "nsat")


@query("c4_enough_satellites_as_text", "select event_id, nsat from tracks where cast(nsat as varchar) > '3'")
def c4_text(spark, sf_dir):
    return trajectory.enough_satellites(data.tracks(spark, sf_dir), as_text=True).select("event_id", "nsat")


@query("c5_template_track", "select event_id, x, y from tracks where session_id = '01-02-M' and animal_id = 'HO01' and hour < 9")
def c5(spark, sf_dir):
    track = routes.template_track(data.tracks(spark, sf_dir), "01-02-M", "HO01")
    return track.filter(F.col("hour") < 9).select("event_id", "x", "y")


STEP = f"""(select *, {dist('x', 'y', 'nx', 'ny')} as steplength from (select *, lead(x) over w as nx, lead(y) over w as ny
  from tracks window w as (partition by session_id, animal_id order by time, event_id)))"""


@query("c6_moving_fixes", f"select event_id, steplength from {STEP} where steplength is null or steplength > 5")
def c6(spark, sf_dir):
    return trajectory.moving(trajectory.step_length(data.tracks(spark, sf_dir))).select("event_id", "steplength")


@query("c7_longitude_band", f"select event_id from tracks where {lon('x', 'y')} > 9.7895 and {lon('x', 'y')} < 9.8")
def c7(spark, sf_dir):
    band = between_open(routes.lon(), routes.LON_MIN, routes.LON_MAX)
    return data.tracks(spark, sf_dir).filter(band).select("event_id")


@query("c8_time_range", "select event_id, time from tracks where time between timestamp '2024-01-10 06:00:00' and timestamp '2024-01-10 09:30:00'")
def c8(spark, sf_dir):
    day = datetime.datetime(2024, 1, 10, tzinfo=datetime.timezone.utc)
    lo, hi = day.replace(hour=6), day.replace(hour=9, minute=30)
    return data.tracks(spark, sf_dir).filter(F.col("time").between(F.lit(lo), F.lit(hi))).select("event_id", "time")


@query("c9_one_trajectory", "select event_id, time_text from raw where source_file = 'R1-HO01.gpkg' and source_layer = '01-03-A'")
def c9(spark, sf_dir):
    one = data.raw_fixes(spark, sf_dir).filter((F.col("source_file") == "R1-HO01.gpkg") & (F.col("source_layer") == "01-03-A"))
    return one.select("event_id", "time_text")


@query("c10_any_gate_crossed", "select event_id, cs as crosses_start, ce as crosses_end from met where cs or ce")
def c10(spark, sf_dir):
    study = data.study(spark, sf_dir)
    start, end = routes.gate_lines(study.setting.gates, 0, 6)
    return trips.gate_events(study.segments, start, end).select("event_id", "crosses_start", "crosses_end")


@query("c11_upper_triangle", "select a, b, n::bigint as n from pairs")
def c11(spark, sf_dir):
    study = data.study(spark, sf_dir)
    return matrix_to_pairs(pair_matrix(study.proximity, study.animals)).select("a", "b", "n")


@query(
    "c12_route_direction_day_part",
    "select session_id, animal_id, gate_no, crossing_time from cr where route = 'trail' and direction = 'back' and day_part = 'A'",
)
def c12(spark, sf_dir):
    cr = data.study(spark, sf_dir).crossings
    kept = cr.filter((F.col("route") == "trail") & (F.col("direction") == "back") & (F.col("day_part") == "A"))
    return kept.select("session_id", "animal_id", "gate_no", "crossing_time")
