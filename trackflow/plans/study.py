"""The whole analysis: fixes -> trips -> order at the gates -> snapshots -> network -> tests."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.operators import crossings, network, snapshots, stats, trajectory, trips
from trackflow.operators.clusters import SEED, snapshot_clusters
from trackflow.operators.routes import gate_lines
from trackflow.operators.tables import materialise


@dataclass(frozen=True)
class Setting:
    """Gates, routes and thresholds of a study.

    gates: (route, gate_no, x1, y1, x2, y2); the first and last gate number
    are the start and end, the same line on every route.
    routes: (route, seq, x, y). in_band: true for fixes between start and end.
    """

    gates: DataFrame
    routes: DataFrame
    in_band: Column
    trail: str = "trail"
    road: str = "road"
    start_gate: int = 0
    end_gate: int = 6
    max_speed: float = trajectory.MAX_SPEED
    min_satellites: int = trajectory.MIN_SATELLITES
    buffer_s: float = trips.BUFFER_SECONDS
    near_metres: float = network.NEAR_METRES


class Study:
    """Every step is computed once when asked for; steps with several users are written tables."""

    def __init__(self, fixes: DataFrame, setting: Setting):
        self.fixes = fixes
        self.setting = setting

    @cached_property
    def segments(self) -> DataFrame:
        good = trajectory.enough_satellites(self.fixes, self.setting.min_satellites)
        return trajectory.drop_speed_outliers(good, self.setting.max_speed)

    @cached_property
    def events(self) -> DataFrame:
        start, end = gate_lines(self.setting.gates, self.setting.start_gate, self.setting.end_gate)
        return materialise(trips.trip_events(self.segments, start, end))

    @cached_property
    def windows(self) -> DataFrame:
        return materialise(trips.session_windows(self.events))

    @cached_property
    def complete(self) -> DataFrame:
        return materialise(trips.complete_trips(self.events))

    @cached_property
    def unrouted(self) -> DataFrame:
        labelled = trips.label_trips(self.segments, self.windows, self.setting.buffer_s)
        return materialise(trips.keep_complete(labelled, self.complete))

    @cached_property
    def assigned(self) -> DataFrame:
        s = self.setting
        return materialise(trips.assign_route(self.unrouted, s.routes, s.in_band, s.trail, s.road))

    @cached_property
    def trips(self) -> DataFrame:
        return trips.join_route(self.unrouted, self.assigned)

    @cached_property
    def crossings(self) -> DataFrame:
        return materialise(crossings.crossings(self.trips, self.setting.gates))

    @cached_property
    def ranked(self) -> DataFrame:
        return crossings.rank_at_gates(self.crossings)

    @cached_property
    def leaders(self) -> DataFrame:
        return materialise(crossings.leaders(self.crossings))

    @cached_property
    def positions(self) -> DataFrame:
        return materialise(snapshots.snapshots(self.trips, self.leaders))

    @cached_property
    def clusters(self) -> DataFrame:
        return materialise(snapshot_clusters(self.positions))

    @cached_property
    def animals(self) -> DataFrame:
        return materialise(self.positions.select("animal_id").distinct())

    @cached_property
    def proximity(self) -> DataFrame:
        return materialise(network.proximity_counts(self.positions, self.setting.near_metres))

    @cached_property
    def pairs(self) -> DataFrame:
        """Proximity counts of all pairs, zeros included, with the breed comparison."""
        return network.same_breed(network.with_zero_pairs(self.proximity, self.animals))

    def gap_summary(self) -> DataFrame:
        return crossings.gap_summary(self.ranked, ["route", "animal_id", "gate_no", "direction"])

    def rank_test(self) -> DataFrame:
        ranked = crossings.rank_at_gates(self.crossings, ["session_id", "direction", "gate_no"])
        return stats.epsilon_squared(stats.kruskal_wallis(ranked, "rank", "animal_id"))

    def mantel(self, permutations: int = stats.PERMUTATIONS, seed: int = SEED) -> DataFrame:
        """Proximity against equal breeds; pairs that never met are not listed for it."""
        labelled = network.nodes(self.animals).withColumnRenamed("breed", "label")
        return stats.mantel_of_labels(self.proximity, labelled, permutations, seed)


def between_x(lo: float, hi: float) -> Column:
    """A band given in grid metres along x."""
    return (F.col("x") > lo) & (F.col("x") < hi)
