"""Who is with whom: pair counts, matrices and edge lists. A pair has a < b."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackflow.functions.columns import breed_from_animal
from trackflow.functions.geometry import distance
from trackflow.operators.snapshots import SNAPSHOT
from trackflow.operators.tables import attach, materialise, row_count

HOT_GROUP = 1000
PAIR_BLOCK = 500
# A matrix has one column per animal.
MAX_MATRIX_ANIMALS = 2000
# Fixed value: animals within five metres are together.
NEAR_METRES = 5.0


def group_join(left: DataFrame, right: DataFrame, on: list[str], condition: Column) -> DataFrame:
    """Inner join of two tables on a group that may be large.

    Groups with more than ``HOT_GROUP`` rows on the right are dealt out over
    several tasks, the left rows being repeated for each; others join plainly.
    """
    sizes = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_GROUP)
    hot = materialise(sizes.select(*on, F.ceil(F.col("_n") / F.lit(HOT_GROUP)).alias("_parts")))
    if row_count(hot) == 0:
        return left.join(right, on).filter(condition)
    parts = F.coalesce(F.col("_parts"), F.lit(1).cast("bigint"))
    right_columns = right.columns
    repeated = attach(left, hot, on).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    dealt = attach(right, hot, on).withColumn("_part", F.pmod(F.xxhash64(*right_columns), parts))
    return repeated.drop("_parts").join(dealt.drop("_parts"), [*on, "_part"]).filter(condition).drop("_part")


def near_rows(pos: DataFrame, metres: float, snapshot: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs at most ``metres`` apart in the same snapshot, each once: (*snapshot, one, two, dist).

    ``one`` and ``two`` are structs (animal_id, px, py, *carry) in either order. Positions are filed in grid cells a little
    wider than the distance, and a cell is joined only with itself and four of its neighbours (the other
    four see it from their side).
    """
    cell = F.lit(metres * 1.000001 if metres > 0 else 1.0)
    placed = pos.filter(F.col("px").isNotNull() & F.col("py").isNotNull()).select(
        *snapshot, F.struct("animal_id", "px", "py", *carry).alias("two"), F.floor(F.col("px") / cell).alias("cx"), F.floor(F.col("py") / cell).alias("cy")
    )
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    here = placed.select(*snapshot, F.col("two").alias("one"), "cx", "cy", F.explode(steps).alias("_d"))
    here = here.withColumns(
        {
            "cx": F.col("cx") + F.col("_d.i"),
            "cy": F.col("cy") + F.col("_d.j"),
            "same_cell": (F.col("_d.i") == 0) & (F.col("_d.j") == 0),
        }
    ).drop("_d")
    far = distance(F.col("one.px"), F.col("one.py"), F.col("two.px"), F.col("two.py"))
    once = ~F.col("same_cell") | (F.col("one.animal_id") < F.col("two.animal_id"))
    joined = group_join(here, placed, [*snapshot, "cx", "cy"], once & (far <= metres))
    return joined.select(*snapshot, "one", "two", far.alias("dist"))


def near_pairs(pos: DataFrame, metres: float = NEAR_METRES, snapshot: list[str] = SNAPSHOT) -> DataFrame:
    """Pairs at most ``metres`` apart in the same snapshot: (*snapshot, a, b, dist)."""
    one, two = F.col("one.animal_id"), F.col("two.animal_id")
    return near_rows(pos, metres, snapshot).select(*snapshot, F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), "dist")


def proximity_counts(pos: DataFrame, metres: float = NEAR_METRES, snapshot: list[str] = SNAPSHOT) -> DataFrame:
    """In how many snapshots each pair was near; pairs never near have no row."""
    return near_pairs(pos, metres, snapshot).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def co_cluster_counts(labels: DataFrame, snapshot: list[str] = SNAPSHOT) -> DataFrame:
    """In how many snapshots each pair was in one cluster; pairs never together have no row."""
    on = [*snapshot, "cluster"]
    here = labels.select(*on, F.col("animal_id").alias("a"))
    there = labels.select(*on, F.col("animal_id").alias("b"))
    return group_join(here, there, on, F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def all_pairs(animals: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every pair a < b of the listed animals.

    The animals are dealt into blocks of about PAIR_BLOCK and every two blocks are joined on their
    numbers, so the pairs are spread over blocks * (blocks + 1) / 2 keys of bounded size.
    """
    if blocks is None:
        blocks = max(1, -(-row_count(animals) // PAIR_BLOCK))
    dealt = animals.select("animal_id", F.pmod(F.xxhash64("animal_id"), F.lit(blocks)).alias("_b"))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    one = dealt.select(F.col("animal_id").alias("id1"), F.col("_b").alias("b1"), F.explode(every).alias("b2"))
    two = dealt.select(F.col("animal_id").alias("id2"), F.col("_b").alias("b2"), F.explode(every).alias("b1"))
    ordered = (F.col("b1") < F.col("b2")) | ((F.col("b1") == F.col("b2")) & (F.col("id1") < F.col("id2")))
    met = one.filter("b1 <= b2").join(two.filter("b1 <= b2"), ["b1", "b2"]).filter(ordered)
    return met.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))


def with_zero_pairs(pairs: DataFrame, animals: DataFrame) -> DataFrame:
    """The pair counts of every pair of the listed animals, 0 where none was counted."""
    return all_pairs(animals).join(pairs, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def same_breed(pairs: DataFrame) -> DataFrame:
    """Adds 1 for two animals of one breed, else 0, and the pair type."""
    same = breed_from_animal(F.col("a")) == breed_from_animal(F.col("b"))
    return pairs.withColumns(
        {
            "same_breed": F.when(same, 1).otherwise(0),
            "pair_type": F.when(same, F.lit("same breed")).when(~same, F.lit("different breed")),
        }
    )


def pair_matrix(pairs: DataFrame, animals: DataFrame) -> DataFrame:
    """The symmetric n x n matrix, zero diagonal: animal_id and one column per animal.

    More than MAX_MATRIX_ANIMALS animals are an error; their pairs stay rows (a, b, n), see ``with_zero_pairs``.
    """
    first = animals.select("animal_id").distinct().orderBy("animal_id").limit(MAX_MATRIX_ANIMALS + 1)
    names = [r["animal_id"] for r in first.collect()]
    if len(names) > MAX_MATRIX_ANIMALS:
        raise ValueError(f"a matrix has at most {MAX_MATRIX_ANIMALS} animals; use with_zero_pairs for rows (a, b, n)")
    both = pairs.select("a", "b", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    wide = both.groupBy(F.col("a").alias("animal_id")).pivot("b", names).agg(F.sum("n"))
    known = animals.select("animal_id").distinct()
    return known.join(wide, "animal_id", "left").select("animal_id", *names).na.fill(0)


def matrix_to_pairs(matrix: DataFrame) -> DataFrame:
    """The upper triangle of a named matrix as pairs, with the pair type."""
    names = [c for c in matrix.columns if c != "animal_id"]
    cells = F.array(*[F.struct(F.lit(n).alias("b"), F.col(n).cast("bigint").alias("n")) for n in names])
    long = matrix.select(F.col("animal_id").alias("a"), F.explode(cells).alias("_cell")).select("a", "_cell.*")
    return same_breed(long.filter(F.col("a") < F.col("b")))


def edge_list(pairs: DataFrame, widest: float) -> DataFrame:
    """Edges of the pairs that met, with line width = weight / largest weight * ``widest``."""
    edges = materialise(pairs.filter(F.col("n") > 0).withColumn("_all", F.lit(1)))
    top = materialise(edges.groupBy("_all").agg(F.max("n").alias("_top")))
    sized = attach(edges, top, ["_all"])
    return sized.withColumn("width", F.col("n") / F.col("_top") * F.lit(widest)).drop("_all", "_top")


def nodes(animals: DataFrame) -> DataFrame:
    return animals.select("animal_id", breed_from_animal(F.col("animal_id")).alias("breed")).distinct()
