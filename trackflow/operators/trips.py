"""From fixes to trips: gate events, session windows, direction, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.functions.columns import shift_seconds
from trackflow.functions.geometry import Line, intersects, point_segment_distance, segment_columns
from trackflow.operators.ordered import neighbours, time_chunk
from trackflow.operators.tables import attach, materialise
from trackflow.operators.trajectory import ORDER, TRACK

OUT, BACK = "out", "back"
# Fixed value: a trip's window is widened by two minutes on both sides.
BUFFER_SECONDS = 120


def gate_events(segs: DataFrame, start: Line, end: Line) -> DataFrame:
    """Fixes whose segment meets the start or the end gate."""
    flags = {
        "crosses_start": intersects(segment_columns(), start),
        "crosses_end": intersects(segment_columns(), end),
    }
    return segs.withColumns(flags).filter(F.col("crosses_start") | F.col("crosses_end"))


def trip_events(segs: DataFrame, start: Line, end: Line) -> DataFrame:
    """Marks, among the gate events of a track, where a way out or back starts and ends."""
    met = materialise(gate_events(segs, start, end).select(*TRACK, *ORDER, "crosses_start", "crosses_end"))
    wanted = {
        "_next_start": ("crosses_start", 1), "_next_end": ("crosses_end", 1),
        "_last_start": ("crosses_start", -1), "_last_end": ("crosses_end", -1),
    }
    near = neighbours(met, TRACK, ORDER, wanted, time_chunk())
    here_start, here_end = F.col("crosses_start"), F.col("crosses_end")

    def seen(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    return near.withColumns(
        {
            "out_start": here_start & seen("_next_end"),
            "back_start": here_end & seen("_next_start"),
            # The event before started a way out (back): it met one gate and
            # this event meets the other.
            "out_end": seen("_last_start") & here_end,
            "back_end": seen("_last_end") & here_start,
        }
    ).drop(*wanted)


def session_windows(events: DataFrame) -> DataFrame:
    """First start and last end of the way out and back per session, over all animals."""

    def when(flag: str) -> Column:
        return F.when(F.col(flag), F.col("time"))

    return events.groupBy("session_id").agg(
        F.min(when("out_start")).alias("out_from"),
        F.max(when("out_end")).alias("out_to"),
        F.min(when("back_start")).alias("back_from"),
        F.max(when("back_end")).alias("back_to"),
    )


def label_trips(fixes: DataFrame, windows: DataFrame, buffer_s: float = BUFFER_SECONDS) -> DataFrame:
    """Keeps fixes inside a trip window and names the direction.

    A session without a window has none (false, not unknown). Inside both
    windows the direction is unknown (NULL).
    """
    timed = attach(fixes, windows, ["session_id"])

    def inside(lo: str, hi: str) -> Column:
        within = (F.col("time") >= shift_seconds(F.col(lo), -buffer_s)) & (
            F.col("time") <= shift_seconds(F.col(hi), buffer_s)
        )
        return F.coalesce(within, F.lit(False))

    out, back = inside("out_from", "out_to"), inside("back_from", "back_to")
    direction = F.when(out & ~back, OUT).when(back & ~out, BACK)
    return (
        timed.filter(out | back)
        .withColumn("direction", direction)
        .drop("out_from", "out_to", "back_from", "back_to")
    )


def complete_trips(events: DataFrame) -> DataFrame:
    """Per animal and session: did it walk the whole way out, and back."""
    return events.groupBy(*TRACK).agg(
        F.bool_or("out_start").alias("out_complete"), F.bool_or("back_start").alias("back_complete")
    )


def keep_complete(trips: DataFrame, complete: DataFrame) -> DataFrame:
    known = attach(trips, complete, TRACK)
    whole = ((F.col("direction") == OUT) & F.col("out_complete")) | (
        (F.col("direction") == BACK) & F.col("back_complete")
    )
    return known.filter(whole).drop("out_complete", "back_complete")


def route_lines(routes: DataFrame) -> DataFrame:
    """The segments of route polylines: (route, seq, x1, y1, x2, y2).

    Vertices are numbered without gaps, so a segment's end is the next number.
    """
    ends = routes.select("route", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return routes.join(ends, ["route", "seq"]).select("route", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def route_distances(fixes: DataFrame, routes: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """Distance of every fix to each named route: (*columns, route, dist). ``columns`` must name a fix.

    Every fix meets the segments of a route inside one task, which keeps only
    the least distance before anything is shuffled.
    """
    lines = materialise(route_lines(routes.filter(F.col("route").isin(names))))
    asked = fixes.select(*columns, "x", "y", F.explode(F.array(*[F.lit(n) for n in names])).alias("route"))
    met = attach(asked, lines.drop("seq"), ["route"], "inner")
    far = point_segment_distance(F.col("x"), F.col("y"), Line(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return met.groupBy(*columns, "route").agg(F.min(far).alias("dist"))


def assign_route(trips: DataFrame, routes: DataFrame, in_band: Column, trail: str, road: str) -> DataFrame:
    """The route of each session and direction: the trail iff it is strictly nearer on average.

    Only fixes inside the open band between the start and end gates count.
    """
    per_fix = route_distances(trips.filter(in_band), routes, [trail, road], [*TRACK, "direction", "event_id"])
    mean = per_fix.groupBy("session_id", "direction").agg(
        F.avg(F.when(F.col("route") == trail, F.col("dist"))).alias("mean_dist_trail"),
        F.avg(F.when(F.col("route") == road, F.col("dist"))).alias("mean_dist_road"),
    )
    nearer = F.col("mean_dist_trail") < F.col("mean_dist_road")
    return mean.withColumn("route", F.when(nearer, F.lit(trail)).when(~nearer, F.lit(road)))


def join_route(trips: DataFrame, assigned: DataFrame) -> DataFrame:
    routed = attach(trips, assigned, ["session_id", "direction"])
    return routed.drop("mean_dist_trail", "mean_dist_road")


def trip_duration(fixes: DataFrame, by: list[str]) -> DataFrame:
    """Minutes between the first and last fix of each group."""
    span = (F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))) / F.lit(60e6)
    return fixes.groupBy(*by).agg(span.alias("duration_min"))
