"""Movement measures against temperature, and the spread of the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.functions.columns import hour_number, seconds_between
from trackflow.functions.geometry import Line, distance
from trackflow.operators.ordered import neighbours, running_total, time_chunk, within_time
from trackflow.operators.snapshots import SNAPSHOT
from trackflow.operators.tables import attach, materialise, row_count
from trackflow.operators.trajectory import ORDER, TRACK
from trackflow.operators.trips import OUT

# Standard lapse rate per km, and the temperatures from which
# animals leave their comfort zone and are under heat stress.
LAPSE_PER_KM = 6.5
WARM_FROM, HOT_FROM = 16.0, 22.0
HULL_PART = 256
TRIP = ["session_id", "animal_id", "direction"]


def temperature_at(df: DataFrame, weather: DataFrame, time: str, station_m: float, site_m: float) -> DataFrame:
    """Adds temp_c of the hour, corrected for the height difference to the station.

    ``weather`` has one row per full hour: (time, temp_c).
    """
    hourly = weather.select(
        hour_number(F.col("time")).alias("_hour"),
        (F.col("temp_c") - F.lit(LAPSE_PER_KM * (site_m - station_m) / 1000.0)).alias("temp_c"),
    )
    return attach(df.withColumn("_hour", hour_number(F.col(time))), materialise(hourly), ["_hour"]).drop("_hour")


def temperature_category(temp: Column) -> Column:
    return F.when(temp < WARM_FROM, "comfort").when(temp < HOT_FROM, "warm").when(temp.isNotNull(), "hot")


def section_durations(cr: DataFrame) -> DataFrame:
    """Seconds between neighbouring gates of a trip: (*trip, route, section, entered, duration_s).

    Section i lies between gates i and i + 1, whichever is met first.
    """
    by = [*TRIP, "route"]
    near = cr.select(*by, F.col("gate_no").alias("section"), F.col("crossing_time").alias("_at_low"))
    far = cr.select(*by, (F.col("gate_no") - 1).alias("section"), F.col("crossing_time").alias("_at_high"))
    both = near.join(far, [*by, "section"])
    return both.select(
        *by,
        "section",
        F.least("_at_low", "_at_high").alias("entered"),
        F.abs(seconds_between(F.col("_at_low"), F.col("_at_high"))).alias("duration_s"),
    )


def moving_speed(segs: DataFrame, reach: int = 2) -> DataFrame:
    """Speed over the segments of the ``reach`` fixes before, this one and ``reach`` after."""
    wanted = {}
    for o in [*range(-reach, 0), *range(1, reach + 1)]:
        wanted[f"_step_{o}"], wanted[f"_lag_{o}"] = ("steplength", o), ("timelag", o)
    near = neighbours(segs, TRACK, ORDER, wanted, time_chunk())

    def total(own: str, prefix: str) -> Column:
        # Summed in time order.
        names = [f"{prefix}{o}" if o else own for o in range(-reach, reach + 1)]
        out = F.lit(0.0)
        for n in names:
            out = out + F.coalesce(F.col(n), F.lit(0.0))
        return out

    way, time = total("steplength", "_step_"), total("timelag", "_lag_")
    return near.withColumn("moving_speed", way / F.when(time > 0, time)).drop(*wanted)


def moving_speed_within(segs: DataFrame, seconds: float) -> DataFrame:
    """Speed over the segments of all fixes of the track at most ``seconds`` before or after: a moving time window."""
    totals = {"_way": F.sum(F.coalesce("steplength", F.lit(0.0))), "_lag": F.sum(F.coalesce("timelag", F.lit(0.0)))}
    near = within_time(segs, TRACK, "time", seconds, seconds, totals)
    return near.withColumn("moving_speed", F.col("_way") / F.when(F.col("_lag") > 0, F.col("_lag"))).drop("_way", "_lag")


def stops(segs: DataFrame, slower_than: float) -> DataFrame:
    """Runs of fixes below a speed, per track: (track, stop_no, fixes, stop_from, stop_to, duration_s, since_last_s).

    A run lasts until the fix after its last slow one. since_last_s is the time
    since the stop before ended.
    """
    timed = segs.select(*TRACK, *ORDER, "time2", "speed")
    slow = timed.withColumn("_slow", F.coalesce(F.col("speed") < slower_than, F.lit(False)))
    marked = materialise(neighbours(slow, TRACK, ORDER, {"_before": ("_slow", -1)}, time_chunk()))
    begins = F.when(F.col("_slow") & ~F.coalesce("_before", F.lit(False)), 1).otherwise(0)
    counted = running_total(marked, TRACK, ORDER, begins.cast("bigint"), time_chunk(), "stop_no")
    runs = counted.filter("_slow").groupBy(*TRACK, "stop_no").agg(
        F.count(F.lit(1)).alias("fixes"), F.min("time").alias("stop_from"), F.max("time2").alias("stop_to")
    )
    runs = materialise(runs.withColumn("duration_s", seconds_between(F.col("stop_from"), F.col("stop_to"))))
    linked = neighbours(runs, TRACK, ["stop_no"], {"_ended": ("stop_to", -1)}, F.floor(F.col("stop_no") / 1024))
    return linked.withColumn("since_last_s", seconds_between(F.col("_ended"), F.col("stop_from"))).drop("_ended")


def sinuosity(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Walked length of every trip over the length of its route: (*trip, route, walked_m, sinuosity)."""
    from trackflow.operators.routes import with_cumulative_distance

    lengths = materialise(with_cumulative_distance(routes).groupBy("route").agg(F.max("cum_dist").alias("_length")))
    walked = trips.groupBy(*TRIP, "route").agg(F.sum("steplength").alias("walked_m"))
    joined = attach(walked, lengths, ["route"])
    return joined.withColumn("sinuosity", F.try_divide(F.col("walked_m"), F.col("_length"))).drop("_length")


def heading(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from grid north, 0 <= h < 360; NULL without a move."""
    angle = F.degrees(F.atan2(x2 - x1, y2 - y1))
    moved = (x1 != x2) | (y1 != y2)
    return F.when(moved, F.when(angle < 0, angle + 360.0).otherwise(angle))


def forward_share(trips: DataFrame, start: Line, end: Line) -> DataFrame:
    """Share of a trip's moves that go towards its destination gate."""
    start, end = start.columns(), end.columns()
    ax = (end.x1 + end.x2) / 2 - (start.x1 + start.x2) / 2
    ay = (end.y1 + end.y2) / 2 - (start.y1 + start.y2) / 2
    along = (F.col("x2") - F.col("x")) * ax + (F.col("y2") - F.col("y")) * ay
    towards = F.when(F.col("direction") == OUT, along).otherwise(-along)
    moves = trips.filter(F.col("steplength") > 0)
    return moves.groupBy(*TRIP).agg(
        F.count(F.lit(1)).alias("moves"), F.avg(F.when(towards > 0, 1.0).otherwise(0.0)).alias("forward_share")
    )


def mean_pair_distance(pos: DataFrame, snapshot: list[str] = SNAPSHOT, block: int = 256) -> DataFrame:
    """Mean distance between any two animals of a snapshot: (*snapshot, animals, mean_dist).

    Positions of a snapshot are dealt into blocks of about ``block`` animals
    held as arrays, and every two blocks meet in one row, so the pairs are
    never rows and a large snapshot is many small tasks.
    """
    placed = materialise(
        pos.filter(F.col("px").isNotNull() & F.col("py").isNotNull()).select(*snapshot, "animal_id", "px", "py")
    )
    sizes = materialise(placed.groupBy(*snapshot).agg(F.count(F.lit(1)).alias("animals")))
    parts = F.ceil(F.col("animals") / F.lit(block))
    dealt = attach(placed, sizes, snapshot).withColumn("_parts", parts)
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("animal_id"), F.col("_parts")))
    point = F.struct("animal_id", "px", "py")
    blocks = materialise(
        dealt.groupBy(*snapshot, "_b").agg(F.collect_list(point).alias("pts"), F.first("_parts").alias("_parts"), F.first("animals").alias("animals"))
    )
    every = F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)
    one = blocks.select(*snapshot, "animals", F.col("_b").alias("b1"), F.explode(every).alias("b2"), F.col("pts").alias("p1"))
    two = blocks.select(*snapshot, F.col("_b").alias("b2"), F.explode(every).alias("b1"), F.col("pts").alias("p2"))
    met = one.filter("b1 <= b2").join(two.filter("b1 <= b2"), [*snapshot, "b1", "b2"])

    def off(p: Column) -> Column:
        fresh = F.filter("p2", lambda q: (F.col("b1") < F.col("b2")) | (p["animal_id"] < q["animal_id"]))
        return F.aggregate(fresh, F.lit(0.0), lambda acc, q: acc + distance(p["px"], p["py"], q["px"], q["py"]))

    summed = met.withColumn("_sum", F.aggregate(F.transform("p1", off), F.lit(0.0), lambda acc, v: acc + v))
    total = summed.groupBy(*snapshot).agg(F.max("animals").alias("animals"), F.sum("_sum").alias("_sum"))
    pairs = F.col("animals") * (F.col("animals") - 1) / 2.0
    return total.withColumn("mean_dist", F.try_divide(F.col("_sum"), pairs)).drop("_sum")


def hull(points: Column) -> Column:
    """The corners of the convex hull of an array of distinct struct(px, py) sorted by both, counter-clockwise from the first.

    Monotone chain as two folds: each place takes from the chain's end the corners it makes needless, and is added. Along
    a convex chain these are the ones from some place on, so they are found by one pass over the chain.
    """

    def left_turn(a: Column, b: Column, c: Column) -> Column:
        return (b["px"] - a["px"]) * (c["py"] - a["py"]) - (b["py"] - a["py"]) * (c["px"] - a["px"]) > 0

    def chain(line: Column) -> Column:
        none = F.slice(line, 1, 0)

        def add(held: Column, p: Column) -> Column:
            # From the end of the chain: how many corners go before the first that stays.
            start = F.struct(F.lit(0).alias("gone"), F.lit(False).alias("stays"))

            def look(state: Column, i: Column) -> Column:
                keeps = left_turn(F.get(held, i - 1), F.get(held, i), p)
                seen = F.struct((state["gone"] + F.when(keeps, 0).otherwise(1)).alias("gone"), keeps.alias("stays"))
                return F.when(state["stays"], state).otherwise(seen)

            inner = F.when(F.size(held) > 1, F.sequence(F.size(held) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
            gone = F.aggregate(inner, start, look, lambda state: state["gone"])
            return F.concat(F.slice(held, F.lit(1), F.size(held) - gone), F.array(p))

        return F.aggregate(line, none, add)

    low, high = chain(points), chain(F.reverse(points))
    ring = F.concat(F.slice(low, F.lit(1), F.size(low) - 1), F.slice(high, F.lit(1), F.size(high) - 1))
    return F.when(F.size(points) < 3, points).otherwise(ring)


def ring_area(ring: Column) -> Column:
    """The area inside a ring of struct(px, py), measured from its first corner."""
    x = lambda i: F.get(ring, i)["px"] - F.get(ring, F.lit(0))["px"]
    y = lambda i: F.get(ring, i)["py"] - F.get(ring, F.lit(0))["py"]
    inner = F.when(F.size(ring) > 2, F.sequence(F.lit(1), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))
    return F.abs(F.aggregate(inner, F.lit(0.0), lambda s, i: s + (x(i) * y(i + 1) - y(i) * x(i + 1)))) / 2


def hull_area(pos: DataFrame, snapshot: list[str] = SNAPSHOT) -> DataFrame:
    """Convex hull area of every snapshot: (*snapshot, corners, area).

    The hull of a whole is the hull of its parts' hulls: parts of about ``HULL_PART`` places are reduced to their
    corners until a snapshot is one part.
    """
    points = pos.filter(F.col("px").isNotNull() & F.col("py").isNotNull()).select(*snapshot, "px", "py").distinct()
    point = F.array_sort(F.collect_list(F.struct("px", "py")))
    while True:
        points = materialise(points)
        sizes = points.groupBy(*snapshot).agg(F.ceil(F.count(F.lit(1)) / F.lit(HULL_PART)).alias("_parts"))
        large = materialise(sizes.filter("_parts > 1"))
        if row_count(large) == 0:
            break
        dealt = attach(points, large, snapshot)
        part = F.pmod(F.xxhash64("px", "py"), F.coalesce("_parts", F.lit(1).cast("bigint")))
        corners = dealt.groupBy(*snapshot, part.alias("_part")).agg(hull(point).alias("ring"))
        fewer = materialise(corners.select(*snapshot, F.explode("ring").alias("c")).select(*snapshot, "c.px", "c.py"))
        if row_count(fewer) == row_count(points):  # all of them are corners of their parts
            points = fewer
            break
        points = fewer
    rings = points.groupBy(*snapshot).agg(hull(point).alias("ring"))
    return rings.select(*snapshot, F.size("ring").alias("corners"), ring_area(F.col("ring")).alias("area"))


def rank_changes(ranked: DataFrame) -> DataFrame:
    """Mean rank of each animal per session and direction and its change since the session before."""
    means = ranked.groupBy("animal_id", "direction", "session_id").agg(
        F.avg("rank").alias("mean_rank"), F.min("crossing_time").alias("first_time")
    )
    means = materialise(means)
    linked = neighbours(
        means, ["animal_id", "direction"], ["first_time", "session_id"], {"_rank_before": ("mean_rank", -1)}, time_chunk("first_time", 7 * 86400)
    )
    return linked.withColumn("change", F.col("mean_rank") - F.col("_rank_before")).drop("_rank_before")
