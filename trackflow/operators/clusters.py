"""K-means of every snapshot at once, with the number of clusters chosen per snapshot.

Every step follows from the rows alone, so that runs repeat and other engines can replay them: starts are the
k places with the smallest md5 of seed, restart, animal and snapshot; a place goes to the nearest centre, the
first on ties; a centre without places stays where it is; centres are kept to six decimals. Errors are compared as
shares of the snapshot's whole spread, to nine decimals: the smallest restart wins among equals, and the
smallest k among equal scores. Clusters are numbered by their centres' place, x before y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackflow.operators.snapshots import SNAPSHOT
from trackflow.operators.tables import attach, materialise

# Cluster numbers tried, and the seed.
K_MIN, K_MAX, SEED = 2, 6, 73
RESTARTS = 100
STILL = 1e-6
PLACES, SHARE_PLACES = 6, 9  # decimals of centres, and of a run's share of the whole spread


def _squares(centres: Column) -> Column:
    """Squared distance of (px, py) to each centre."""

    def one(c: Column) -> Column:
        dx, dy = F.col("px") - c["x"], F.col("py") - c["y"]
        return dx * dx + dy * dy

    return F.transform(centres, one)


def _nearest(points: DataFrame, centres: DataFrame, snapshot: list[str]) -> DataFrame:
    """Adds the nearest centre (1..k, first on ties) and its squared distance."""
    measured = attach(points, centres, snapshot, "inner").withColumn("_sq", _squares(F.col("centres")))
    least = F.array_min("_sq")
    return measured.withColumns({"sq": least, "cluster": F.array_position(F.col("_sq"), least).cast("int")}).drop("_sq")


def _starts(points: DataFrame, sizes: DataFrame, snapshot: list[str], k_min: int, k_max: int, restarts: int, seed: int) -> DataFrame:
    """Per snapshot, k and restart: the k points of the smallest hashes, (snapshot, k, run, centres).

    The row_number bound lets every task send on at most ``k_max`` points per
    snapshot and restart.
    """
    drawn = attach(points, sizes, snapshot, "inner").withColumn(
        "run", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))
    )
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("run").cast("string"), "animal_id", *[F.col(c).cast("string") for c in snapshot]))
    w = Window.partitionBy(*snapshot, "run").orderBy("_key", "animal_id")
    first = drawn.withColumn("_key", key).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k_max)
    counts = F.explode(F.sequence(F.lit(k_min), F.lit(k_max)))
    per_k = first.withColumn("k", counts).filter((F.col("place") <= F.col("k")) & (F.col("k") < F.col("n")))
    centre = F.struct(F.col("px").alias("x"), F.col("py").alias("y"))
    return per_k.groupBy(*snapshot, "k", "run").agg(F.sort_array(F.collect_list(centre)).alias("centres"))


def snapshot_clusters(
    pos: DataFrame,
    snapshot: list[str] = SNAPSHOT,
    k_min: int = K_MIN,
    k_max: int = K_MAX,
    seed: int = SEED,
    restarts: int = RESTARTS,
) -> DataFrame:
    """Labels each position with its cluster, k being the best by Calinski-Harabasz.

    All snapshots, cluster numbers and restarts move together: one pass
    assigns points to centres and averages per centre, so a snapshot of any
    size is spread over all tasks. A run leaves the loop once its centres
    stand still. Snapshots with fewer than three positions get no label row.
    """
    points = materialise(
        pos.filter(F.col("px").isNotNull() & F.col("py").isNotNull()).select(*snapshot, "animal_id", "px", "py")
    )
    whole = points.groupBy(*snapshot).agg(
        F.count(F.lit(1)).alias("n"), F.avg("px").alias("mx"), F.avg("py").alias("my")
    )
    sizes = materialise(whole.filter("n >= 3"))
    run = [*snapshot, "k", "run"]
    active = materialise(_starts(points, sizes.select(*snapshot, "n"), snapshot, k_min, k_max, restarts, seed))
    done: list[DataFrame] = []
    while not active.isEmpty():
        placed = _nearest(points, active, snapshot)
        mean = [F.round(F.avg(c), PLACES).alias(name) for c, name in (("px", "x"), ("py", "y"))]
        means = placed.groupBy(*run, "cluster").agg(*mean)
        entry = F.struct("cluster", F.struct("x", "y").alias("c"))
        new = means.groupBy(*run).agg(F.map_from_entries(F.collect_list(entry)).alias("_new"))
        joined = active.join(new, run)
        moved = F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("_new", (i + 1).cast("int")), c))
        far = F.array_max(
            F.zip_with("centres", "_moved", lambda p, q: F.greatest(F.abs(p["x"] - q["x"]), F.abs(p["y"] - q["y"])))
        )
        stepped = materialise(
            joined.withColumn("_moved", moved).select(*run, F.col("_moved").alias("centres"), (far > STILL).alias("_go"))
        )
        done.append(stepped.filter(~F.col("_go")).drop("_go"))
        active = stepped.filter("_go").drop("_go")
    if not done:
        return points.withColumn("cluster", F.lit(None).cast("int")).withColumn("k", F.lit(None).cast("int")).limit(0)
    final = done[0]
    for more in done[1:]:
        final = final.unionByName(more)
    final = materialise(final)
    spread = attach(points, sizes, snapshot, "inner")
    dx, dy = F.col("px") - F.col("mx"), F.col("py") - F.col("my")
    total = spread.groupBy(*snapshot).agg(F.max("n").alias("n"), F.sum(dx * dx + dy * dy).alias("sst"))
    errors = _nearest(points, final, snapshot).groupBy(*run).agg(F.sum("sq").alias("ssw")).join(final, run).join(total, snapshot)
    left = F.round(F.coalesce(F.try_divide("ssw", "sst"), F.lit(0.0)), SHARE_PLACES)
    errors = errors.withColumn("left", left)
    best = errors.groupBy(*snapshot, "k").agg(F.min_by(F.struct("centres", "left", "n"), F.struct("left", "run")).alias("_b"))
    best = best.select(*snapshot, "k", "_b.*")
    score = F.try_divide((1 - F.col("left")) / (F.col("k") - 1), F.col("left") / (F.col("n") - F.col("k")))
    scored = best.withColumn("score", F.coalesce(score, F.lit(float("inf"))))
    chosen = scored.groupBy(*snapshot).agg(
        F.max_by(F.struct(F.sort_array("centres").alias("centres"), "k"), F.struct(F.col("score"), -F.col("k"))).alias("_c")
    )
    chosen = materialise(chosen.select(*snapshot, "_c.*"))
    return _nearest(points, chosen, snapshot).select(*snapshot, "animal_id", "px", "py", "k", "cluster")
