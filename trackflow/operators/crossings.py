"""Gate crossing times, order and gaps at the gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackflow.functions.columns import epoch_seconds, interleaved, round_to_second, seconds_between
from trackflow.functions.geometry import (
    cut_share,
    distance,
    gate_columns,
    intersects,
    point_segment_distance,
    segment_columns,
)
from trackflow.operators.ordered import mid_ranks, running_total, time_chunk
from trackflow.operators.tables import attach, materialise

GATE_GROUP = ["route", "session_id", "direction", "gate_no"]


def _gates(gates: DataFrame) -> DataFrame:
    return gates.select(
        "route",
        "gate_no",
        F.col("x1").alias("gx1"),
        F.col("y1").alias("gy1"),
        F.col("x2").alias("gx2"),
        F.col("y2").alias("gy2"),
    )


def all_crossings(trips: DataFrame, gates: DataFrame) -> DataFrame:
    """Every meeting of a fix's segment with a gate of its trip's route, with its time.

    A segment of no length meets a gate at an unknown time (NULL).
    """
    hit = attach(trips, _gates(gates), ["route"], "inner", intersects(segment_columns(), gate_columns()))
    t = cut_share(segment_columns(), gate_columns())
    hit = hit.withColumns(
        {
            "cut_x": F.col("x") + t * (F.col("x2") - F.col("x")),
            "cut_y": F.col("y") + t * (F.col("y2") - F.col("y")),
        }
    )
    share = distance(F.col("x"), F.col("y"), F.col("cut_x"), F.col("cut_y")) / F.when(
        F.col("steplength") > 0, F.col("steplength")
    )
    hit = hit.withColumn("share", share)
    at = round_to_second(epoch_seconds(F.col("time")) + F.col("share") * F.col("timelag"))
    return hit.withColumn("crossing_time", at).drop("gx1", "gy1", "gx2", "gy2")


def first_crossings(hits: DataFrame) -> DataFrame:
    """The first crossing per animal, trip and gate; unknown times come last."""
    by = ["session_id", "animal_id", "direction", "route", "gate_no"]
    when = F.struct(F.col("crossing_time").isNull(), "crossing_time", "time", "event_id")
    kept = F.struct("crossing_time", "breed", F.substring("session_id", 7, 1).alias("day_part"))
    return hits.groupBy(*by).agg(F.min_by(kept, when).alias("_first")).select(*by, "_first.*")


def crossings(trips: DataFrame, gates: DataFrame) -> DataFrame:
    return first_crossings(all_crossings(trips, gates))


def rank_at_gates(cr: DataFrame, by: list[str] = GATE_GROUP) -> DataFrame:
    """Adds each animal's rank (ties share the mean) and gap in seconds to the first.

    Reads ``cr`` several times: pass a written table.
    """
    timed = cr.filter(F.col("crossing_time").isNotNull())
    first = materialise(timed.groupBy(*by).agg(F.min("crossing_time").alias("_first_time")))
    ranked = mid_ranks(timed, by, "crossing_time", "rank", time_chunk("crossing_time"))
    gap = seconds_between(F.col("_first_time"), F.col("crossing_time"))
    return attach(ranked, first, by).withColumn("gap", gap).drop("_first_time")


def gap_summary(ranked: DataFrame, by: list[str]) -> DataFrame:
    return ranked.groupBy(*by).agg(F.avg("rank").alias("mean_rank"), F.avg("gap").alias("mean_gap"))


def mean_rank_by_animal(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("animal_id", "breed").agg(F.avg("rank").alias("mean_rank"))


def display_order(mean_ranks: DataFrame) -> DataFrame:
    """Per breed, the interleaved shade number of each animal by mean rank."""
    return interleaved(mean_ranks, ["breed"], "mean_rank", "animal_id", "shade")


def leaders(cr: DataFrame) -> DataFrame:
    """The first animal at each gate of each trip; its time is the snapshot time."""
    by = ["session_id", "direction", "gate_no"]
    when = F.struct("crossing_time", "animal_id")
    timed = cr.filter(F.col("crossing_time").isNotNull())
    first = timed.groupBy(*by).agg(F.min(when).alias("_first"))
    return first.select(*by, F.col("_first.crossing_time").alias("ref_time"), F.col("_first.animal_id").alias("leader_id"))


def nearest_to_gate(fixes: DataFrame, gates: DataFrame, by: list[str]) -> DataFrame:
    """The fixes nearest to each gate per group, ties kept, with their distance."""
    lines = gates.select(F.lit(1).alias("_set"), "gate_no", *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    asked = attach(fixes.withColumn("_set", F.lit(1)), lines, ["_set"], "inner").drop("_set")
    far = point_segment_distance(F.col("x"), F.col("y"), gate_columns())
    asked = asked.withColumn("dist", far).drop("gx1", "gy1", "gx2", "gy2")
    least = materialise(asked.groupBy(*by, "gate_no").agg(F.min("dist").alias("_least")))
    return attach(asked, least, [*by, "gate_no"], "inner", F.col("dist") == F.col("_least")).drop("_least")


def order_at_gate(nearest: DataFrame, by: list[str]) -> DataFrame:
    """Row number by time of day within each group (equal times by event_id)."""
    numbered = running_total(
        nearest,
        by,
        ["time_of_day", "event_id"],
        F.lit(1),
        F.substring("time_of_day", 1, 5),
        "rank",
    )
    return numbered.withColumn("rank", F.col("rank").cast("int"))
