"""As-of joins, positions at a moment, and clusters of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.functions.columns import seconds_between
from trackflow.operators.ordered import neighbours, time_chunk
from trackflow.operators.tables import attach, materialise

SNAPSHOT = ["session_id", "direction", "gate_no"]
BUCKET_SECONDS = 300


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name))


def _match_spans(spans: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Joins spans [_from, _until) (NULL = open) with the moments inside them.

    Both sides are cut into time buckets, so a key with many fixes or many
    moments is spread over many (key, bucket) groups.
    """
    width = BUCKET_SECONDS * 1_000_000
    refs = materialise(refs.withColumn("_bucket", F.floor(_micros("ref_time") / F.lit(width))))
    ends = materialise(refs.groupBy(*keys).agg(F.min(_micros("ref_time")).alias("_lo"), F.max(_micros("ref_time")).alias("_hi")))
    clipped = attach(spans, ends, keys, "inner")
    start = F.greatest(F.coalesce(_micros("_from"), F.col("_lo")), F.col("_lo"))
    stop = F.least(F.coalesce(_micros("_until") - 1, F.col("_hi")), F.col("_hi"))
    buckets = F.sequence(F.floor(start / F.lit(width)), F.floor(stop / F.lit(width)))
    spread = clipped.filter(start <= stop).withColumn("_bucket", F.explode(buckets)).drop("_lo", "_hi")
    inside = (F.col("_from").isNull() | (F.col("_from") <= F.col("ref_time"))) & (
        F.col("_until").isNull() | (F.col("ref_time") < F.col("_until"))
    )
    return attach(spread, refs, [*keys, "_bucket"], "inner", inside).drop("_bucket")


def asof_last(fixes: DataFrame, refs: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """For every moment and ``by`` group of its key: the last fix at or before it.

    ``refs`` has ``keys``, ref_time and any further columns. Of fixes with the
    same time the first (lowest event_id) counts.
    """
    # Equal times in falling event_id: only the last of them, the lowest id,
    # has a span that is not empty.
    ordered = fixes.withColumn("_down", -F.col("event_id"))
    spans = neighbours(ordered, [*keys, *by], ["time", "_down"], {"_until": ("time", 1)}, time_chunk())
    spans = spans.filter(F.col("_until").isNull() | (F.col("time") < F.col("_until")))
    return _match_spans(spans.withColumn("_from", F.col("time")), refs, keys).drop("_from", "_until", "_down")


def asof_nearest(fixes: DataFrame, refs: DataFrame, keys: list[str], by: list[str], ties: bool = True) -> DataFrame:
    """For every moment and ``by`` group of its key: the fixes nearest in time.

    Equally near fixes are all kept, or with ``ties=False`` only the first by
    time and event_id.
    """
    group = [*keys, *by]
    times = fixes.select(*group, "time").distinct()
    around = neighbours(times, group, ["time"], {"_next": ("time", 1), "_last": ("time", -1)}, time_chunk())
    unknown = F.lit(None).cast("timestamp")
    after = F.struct(F.col("time").alias("_from"), F.col("_next").alias("_until"))
    before_first = F.when(
        F.col("_last").isNull(), F.struct(unknown.alias("_from"), F.col("time").alias("_until"))
    )
    spans = around.select(*group, F.explode(F.array_compact(F.array(after, before_first))).alias("_s"))
    met = _match_spans(spans.select(*group, "_s.*"), refs, keys)
    back, ahead = seconds_between(F.col("_from"), F.col("ref_time")), seconds_between(F.col("ref_time"), F.col("_until"))
    near_back = F.col("_until").isNull() | (back <= ahead)
    near_ahead = F.col("_from").isNull() | (ahead <= back)
    best = F.array_compact(F.array(F.when(near_back, F.col("_from")), F.when(near_ahead, F.col("_until"))))
    chosen = materialise(met.withColumn("time", F.explode(best)).drop("_from", "_until"))
    found = attach(fixes, chosen, [*group, "time"], "inner")
    found = found.withColumn("diff_s", F.abs(seconds_between(F.col("time"), F.col("ref_time"))))
    if ties:
        return found
    moment = [c for c in refs.columns if c not in keys]
    one = [*group, *moment]
    rest = [c for c in found.columns if c not in one]
    kept = found.groupBy(*one).agg(F.min_by(F.struct(*rest), F.struct("time", "event_id")).alias("_row"))
    return kept.select(*one, "_row.*")


def position_at(fixes: DataFrame, moment: str = "ref_time") -> DataFrame:
    """Adds px, py: the place on the fix's segment at ``moment`` (linear, not clamped)."""
    share = F.try_divide(seconds_between(F.col("time"), F.col(moment)), F.col("timelag"))
    placed = fixes.withColumn("share", share)
    return placed.withColumns(
        {
            "px": F.col("x") + F.col("share") * (F.col("x2") - F.col("x")),
            "py": F.col("y") + F.col("share") * (F.col("y2") - F.col("y")),
        }
    )


def snapshots(trips: DataFrame, leaders: DataFrame) -> DataFrame:
    """Where every animal of a trip was when the first one met a gate."""
    columns = ["session_id", "direction", "animal_id", "time", "event_id", "x", "y", "x2", "y2", "timelag"]
    refs = leaders.select(*SNAPSHOT, "ref_time")
    return position_at(asof_last(trips.select(*columns), refs, ["session_id", "direction"], ["animal_id"]))


def calinski_harabasz(points: DataFrame, group: list[str], cluster: str = "cluster") -> DataFrame:
    """(SSB/(k-1)) / (SSW/(n-k)) of a labelled set of points (px, py) per group.

    Within-cluster squares come from sums relative to a local origin, so the
    whole is one partial aggregate per cluster and one per group.
    """
    origin = materialise(points.groupBy(*group).agg(F.avg("px").alias("_ox"), F.avg("py").alias("_oy")))
    local = attach(points, origin, group).withColumns(
        {"_dx": F.col("px") - F.col("_ox"), "_dy": F.col("py") - F.col("_oy")}
    )
    per = local.groupBy(*group, cluster).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_dx").alias("_sx"),
        F.sum("_dy").alias("_sy"),
        F.sum(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")).alias("_sq"),
    )
    pull = (F.col("_sx") * F.col("_sx") + F.col("_sy") * F.col("_sy")) / F.col("_n")
    whole = per.groupBy(*group).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("_n").alias("n"),
        F.sum(pull).alias("ssb"),
        F.sum(F.col("_sq") - pull).alias("ssw"),
    )
    score = F.try_divide(
        F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))
    )
    return whole.withColumn("score", F.when((F.col("k") > 1) & (F.col("n") > F.col("k")), score))
