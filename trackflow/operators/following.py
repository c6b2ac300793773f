"""Who follows whom: a relation between animals at equal times, its unbroken runs, and who leads for how long.

A follower has its leader ahead of it, in a cone around its own heading and not far away, and both head the same way. A leader
is followed and follows nobody.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.operators.network import near_rows
from trackflow.operators.ordered import neighbours, running_total
from trackflow.operators.tables import materialise
from trackflow.operators.trajectory import ORDER

TICK_SECONDS = 20
MOMENT = ["session_id", "tick"]


def headings(segs: DataFrame, seconds: int = TICK_SECONDS) -> DataFrame:
    """(session_id, tick, animal_id, px, py, ux, uy): each animal's first fix in every ``seconds``, with the unit vector of its move.

    A fix without a move has no heading (NULL); it may lead nobody and follow nobody.
    """
    way = F.when(F.col("steplength") > 0, F.col("steplength"))
    tick = F.floor(F.unix_micros("time") / F.lit(seconds * 1_000_000)).alias("tick")
    shown = F.struct(
        F.col("x").alias("px"), F.col("y").alias("py"), ((F.col("x2") - F.col("x")) / way).alias("ux"), ((F.col("y2") - F.col("y")) / way).alias("uy")
    )
    first = segs.groupBy("session_id", tick, "animal_id").agg(F.min_by(shown, F.struct(*ORDER)).alias("f"))
    return first.select("session_id", "tick", "animal_id", "f.*")


def follows(moving: DataFrame, metres: float, cone_degrees: float, turn_degrees: float) -> DataFrame:
    """(session_id, tick, leader, follower, dist): who has whom ahead.

    The leader is at most ``metres`` away, within the cone of ``cone_degrees`` that opens along the follower's heading, and the
    headings differ by ``turn_degrees`` at most. Animals at the very same place do not follow each other.
    """
    half, turn = math.cos(math.radians(cone_degrees / 2)), math.cos(math.radians(turn_degrees))
    one, two = F.col("one"), F.col("two")

    def ahead(follower: Column, leader: Column) -> Column:
        dx, dy = leader["px"] - follower["px"], leader["py"] - follower["py"]
        return dx * follower["ux"] + dy * follower["uy"] >= F.lit(half) * F.col("dist")

    def named(leader: Column, follower: Column) -> Column:
        return F.struct(leader["animal_id"].alias("leader"), follower["animal_id"].alias("follower"))

    moved = moving.filter(F.col("ux").isNotNull() & F.col("uy").isNotNull())
    met = near_rows(moved, metres, MOMENT, ("ux", "uy")).filter(F.col("dist") > 0)
    met = met.filter(one["ux"] * two["ux"] + one["uy"] * two["uy"] >= F.lit(turn))
    both = F.array(F.when(ahead(one, two), named(two, one)), F.when(ahead(two, one), named(one, two)))
    return met.select(*MOMENT, "dist", F.explode(F.filter(both, lambda r: r.isNotNull())).alias("r")).select(*MOMENT, "r.*", "dist")


def runs(held: DataFrame, keys: list[str], least_ticks: int = 1) -> DataFrame:
    """Unbroken runs of ticks per ``keys``: (*keys, run_no, ticks, from_tick, to_tick). ``held`` has one row per key and tick.

    Runs are numbered among all of a key before the short ones go.
    """
    chunk = F.floor(F.col("tick") / 1024)
    ticks = held.select(*keys, "tick")
    marked = materialise(neighbours(ticks, keys, ["tick"], {"_before": ("tick", -1)}, chunk))
    begins = F.when(F.col("tick") == F.col("_before") + 1, 0).otherwise(1).cast("bigint")
    counted = running_total(marked.withColumn("_begins", begins), keys, ["tick"], F.col("_begins"), chunk, "run_no")
    found = counted.groupBy(*keys, "run_no").agg(
        F.count(F.lit(1)).alias("ticks"), F.min("tick").alias("from_tick"), F.max("tick").alias("to_tick")
    )
    return found.filter(F.col("ticks") >= least_ticks)


def follow_runs(relation: DataFrame, least_ticks: int) -> DataFrame:
    """How long each follower stayed behind each leader: (session_id, leader, follower, run_no, ticks, from_tick, to_tick)."""
    return runs(relation, ["session_id", "leader", "follower"], least_ticks)


def leading(relation: DataFrame, least_followers: int) -> DataFrame:
    """(session_id, tick, animal_id, followers): followed by ``least_followers`` or more while following nobody."""
    led = relation.groupBy(*MOMENT, F.col("leader").alias("animal_id")).agg(F.count(F.lit(1)).alias("followers"))
    behind = relation.select(*MOMENT, F.col("follower").alias("animal_id")).distinct()
    return led.filter(F.col("followers") >= least_followers).join(behind, [*MOMENT, "animal_id"], "left_anti")


def time_led(relation: DataFrame, least_followers: int, least_ticks: int, seconds: int = TICK_SECONDS) -> DataFrame:
    """Who led how long: (animal_id, sessions, times, led_s, longest_s) over runs of ``least_ticks`` or more."""
    times = runs(leading(relation, least_followers), ["session_id", "animal_id"], least_ticks)
    return times.groupBy("animal_id").agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count(F.lit(1)).alias("times"),
        (F.sum("ticks") * seconds).alias("led_s"),
        (F.max("ticks") * seconds).alias("longest_s"),
    )
