"""Discrete Fréchet distance of tracks: the least largest gap of two walkers who each pass their fixes in order.

The table of the dynamic program is filled by anti-diagonals. A diagonal depends on the two before it only, so three are kept.
``discrete_frechet`` does this for one pair as column expressions. ``frechet_pairs`` takes the tracks of every two
blocks as one group of a cogroup and works out the diagonals of many pairs at once with numpy. There the distance of a
walk that greedily takes the nearest next places is an upper bound, and cells beyond it lie on no best walk: a diagonal is filled
from the first to the last cell that is within the bound only.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trackflow.operators.ordered import neighbours, time_chunk
from trackflow.operators.tables import attach, materialise
from trackflow.operators.trajectory import ORDER

# A track is one array. Longer ones are an error; thin them in time first.
MAX_POINTS = 100_000
BLOCK = 16  # tracks that meet another block's tracks in one row
BLOCK_POINTS = 1 << 15  # places that a block should have together, so that long tracks are spread over more groups
MOST_PAIRS, MOST_PLACES = 128, 1 << 19  # pairs, and places of either side, that are worked out at once
TRIM = 8  # diagonals between two looks at which cells are within the bound

# Python workers may start in a folder from which the package cannot be imported.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lines(fixes: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, points, x_min, x_max, y_min, y_max): each group's places in order of time, without repeating the place before.

    Standing still changes no Fréchet distance, so a walker's rests cost nothing.
    """
    placed = fixes.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*keys, *ORDER, "x", "y")
    near = neighbours(placed, keys, ORDER, {"_x": ("x", -1), "_y": ("y", -1)}, time_chunk())
    moved = near.filter(~F.coalesce((F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), F.lit(False)))
    points = F.array_sort(F.collect_list(F.struct(*ORDER, "x", "y")))
    box = [F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")]
    made = moved.groupBy(*keys).agg(points.alias("points"), *box)
    too_long = F.size("points") > MAX_POINTS
    checked = F.when(too_long, F.raise_error(F.lit(f"a track has more than {MAX_POINTS} places"))).otherwise(F.col("points"))
    return made.withColumn("points", F.transform(checked, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once; lambdas are not compiled, and would repeat it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def discrete_frechet(p: Column, q: Column) -> Column:
    """The distance of two arrays of struct(x, y); NULL if one has none. Time grows with the product of the lengths, memory with the sum."""
    n, m = F.size(p), F.size(q)
    turned = F.reverse(q)
    low = lambda k: F.greatest(F.lit(0), k - m + 1)

    def gap2(a: Column, b: Column) -> Column:
        return (b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])

    def diagonal(k: Column, last: Column, before: Column) -> Column:
        """Cells (i, k - i) from i = low(k) on; ``last`` and ``before`` are those of k - 1 and k - 2."""
        size = F.least(n - 1, k) - low(k) + 1
        gaps = F.zip_with(F.slice(p, low(k) + 1, size), F.slice(turned, m - k + low(k), size), gap2)
        shifts = F.struct((low(k) - low(k - 1)).alias("one"), (low(k) - low(k - 2)).alias("two"), gaps.alias("gaps"))

        def cells(s: Column) -> Column:
            come = lambda t: F.least(F.get(last, t + s["one"]), F.get(last, t + s["one"] - 1), F.get(before, t + s["two"] - 1))
            return F.transform(s["gaps"], lambda g, t: F.greatest(g, come(t)))

        return _once(shifts, cells)

    first = F.array(gap2(F.get(p, F.lit(0)), F.get(q, F.lit(0))))
    start = F.struct(first.alias("last"), F.slice(first, 1, 0).alias("before"))
    steps = F.when(n + m > 2, F.sequence(F.lit(1), n + m - 2)).otherwise(F.array().cast("array<int>"))
    filled = F.aggregate(
        steps, start, lambda acc, k: F.struct(diagonal(k, acc["last"], acc["before"]).alias("last"), acc["last"].alias("before")), lambda acc: F.get(acc["last"], F.lit(0))
    )
    return F.when((n > 0) & (m > 0), F.sqrt(filled))


def _halves(made: DataFrame, group: list[str], by: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The tracks of every two blocks b1 <= b2 of a group: (*group, b1, b2, l1) and (*group, b1, b2, l2)."""
    held = materialise(made)
    parts = F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum(F.size("points").cast("long")) / F.lit(BLOCK_POINTS))
    sizes = materialise(held.groupBy(*group).agg(F.ceil(parts).alias("_parts")))
    dealt = attach(held, sizes, group).withColumn("_b", F.pmod(F.xxhash64(by), F.col("_parts")))
    line = F.struct(*[c for c in made.columns if c not in group])
    blocks = materialise(dealt.groupBy(*group, "_b").agg(F.collect_list(line).alias("ls")))
    present = materialise(blocks.groupBy(*group).agg(F.collect_set("_b").alias("_every")))
    blocks, every = attach(blocks, present, group, "inner"), F.col("_every")
    left = blocks.select(*group, F.col("_b").alias("b1"), F.explode(every).alias("b2"), F.col("ls").alias("l1"))
    right = blocks.select(*group, F.explode(every).alias("b1"), F.col("_b").alias("b2"), F.col("ls").alias("l2"))
    return left.filter("b1 <= b2"), right.filter("b1 <= b2")


def line_pairs(made: DataFrame, group: list[str], by: str = "animal_id", block: int = BLOCK) -> DataFrame:
    """Every two tracks of a group: (*group, one, two), structs of the other columns of ``lines`` with one.by < two.by.

    Tracks are dealt into blocks, and every two blocks meet in one row, so a track is sent once per block of its
    group rather than once per pair.
    """
    left, right = _halves(made, group, by, block)
    met = left.join(right, [*group, "b1", "b2"])

    def others(one: Column) -> Column:
        fresh = F.filter("l2", lambda two: (F.col("b1") < F.col("b2")) | (one[by] < two[by]))
        ordered = lambda two: F.when(one[by] < two[by], F.struct(one.alias("one"), two.alias("two"))).otherwise(F.struct(two.alias("one"), one.alias("two")))
        return F.transform(fresh, ordered)

    return met.select(*group, F.explode(F.flatten(F.transform("l1", others))).alias("p")).select(*group, "p.one", "p.two")


def least_possible(one: Column, two: Column) -> Column:
    """A lower bound of the distance: that of the first places, of the last ones, and of the boxes' sides."""

    def gap(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return F.sqrt(dx * dx + dy * dy)

    sides = [F.abs(one[c] - two[c]) for c in ("x_min", "x_max", "y_min", "y_max")]
    ends = [gap(F.element_at(one["points"], i), F.element_at(two["points"], i)) for i in (1, -1)]
    return F.greatest(*sides, *ends)


def _gap2(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    return dx * dx + dy * dy


def _greedy(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of a walk that always takes the nearest of the next places; an upper bound for each pair."""
    (_, n, pairs), m = p.shape, q.shape[1]
    of = np.arange(pairs)
    i, j = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    most = _gap2(q[0, 0] - p[0, 0], q[1, 0] - p[1, 0])
    while (i + j).min() < n + m - 2:
        a, b = np.minimum(i + 1, n - 1), np.minimum(j + 1, m - 1)
        ways = np.array([_gap2(q[0, v, of] - p[0, u, of], q[1, v, of] - p[1, u, of]) for u, v in ((a, b), (a, j), (i, b))])
        # At the end of one track a step along it alone would stand still.
        ways[1][(i == n - 1) & (j < m - 1)] = np.inf
        ways[2][(j == m - 1) & (i < n - 1)] = np.inf
        best = ways.argmin(axis=0)
        i, j = np.where(best == 2, i, a), np.where(best == 1, j, b)
        most = np.maximum(most, ways[best, of])
    return most


def _squares(p: np.ndarray, q: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of pairs of tracks of the same lengths, ``p`` (2, n, pairs) and ``q`` (2, m, pairs).

    With a ``bound`` (squared, for each pair) those beyond it need not be right, but are beyond it or NaN; without one all are right.
    A cell that cannot be reached is NaN, which ``fmin`` passes over and ``maximum`` keeps.
    """
    (_, n, pairs), m = p.shape, q.shape[1]
    limit = _greedy(p, q) if bound is None else bound
    trims = bool(np.isfinite(limit).all())
    turned = np.ascontiguousarray(q[:, ::-1])
    # Cell (i, k - i) of diagonal k is row i + 1; ``held`` are the rows that a diagonal has filled.
    kept, held = np.full((3, n + 1, pairs), np.nan), [(0, 0)] * 3
    low, high = 0, 1  # rows i of the diagonal
    for k in range(n + m - 1):
        now, last, before = kept[k % 3], kept[(k - 1) % 3], kept[(k - 2) % 3]
        now[slice(*held[k % 3])] = np.nan
        if k:
            low, high = max(low, k - m + 1), min(high + 1, n, k + 1)
        if low >= high:
            return np.full(pairs, np.nan)
        shift = m - 1 - k
        gaps = _gap2(turned[0, shift + low : shift + high] - p[0, low:high], turned[1, shift + low : shift + high] - p[1, low:high])
        if k:
            come = np.fmin(last[low + 1 : high + 1], last[low:high])
            np.fmin(come, before[low:high], out=come)
            np.maximum(gaps, come, out=gaps)
        now[low + 1 : high + 1] = gaps
        held[k % 3] = (low + 1, high + 1)
        if trims and k % TRIM == 0:
            # A next cell comes from this diagonal or the one before.
            near = (gaps <= limit).any(axis=1)
            near[: high - low] |= (last[low + 1 : high + 1] <= limit).any(axis=1)
            alive = np.flatnonzero(near)
            if not len(alive):
                return np.full(pairs, np.nan)
            low, high = low + int(alive[0]), low + int(alive[-1]) + 1
    return kept[(n + m - 2) % 3][n]


def _padded(tracks: list[np.ndarray]) -> np.ndarray:
    """Tracks (2, length) as one array (2, longest, tracks): the shorter ones stand still at their end, which changes no distance."""
    longest = max(t.shape[1] for t in tracks)
    return np.stack([np.pad(t, ((0, 0), (0, longest - t.shape[1])), mode="edge") for t in tracks], axis=2)


def distances(ones: list[np.ndarray], twos: list[np.ndarray], pairs: np.ndarray, within: float | None = None) -> np.ndarray:
    """The distance of each pair (row of numbers in ``ones`` and ``twos``) of tracks (2, length); with a bound, NaN for those beyond it."""
    found = np.full(len(pairs), np.nan)
    if within is not None:
        # Beyond the bound are first and last places, or sides of boxes, that are further apart: no table is filled.
        ends, boxes = ([np.array([f(t) for t in side]) for side in (ones, twos)] for f in (lambda t: t[:, [0, -1]], lambda t: np.stack([t.min(axis=1), t.max(axis=1)])))
        a, b = pairs[:, 0], pairs[:, 1]
        steps = ends[1][b] - ends[0][a]
        apart = np.sqrt(_gap2(steps[:, 0], steps[:, 1])).max(axis=1)
        sides = np.abs(boxes[1][b] - boxes[0][a]).max(axis=(1, 2))
        order = np.flatnonzero(~(np.maximum(apart, sides) > within))
    else:
        order = np.arange(len(pairs))
    sizes = np.array([(ones[i].shape[1], twos[j].shape[1]) for i, j in pairs[order]]).reshape(-1, 2)
    by_size = np.lexsort((sizes[:, 1], sizes[:, 0]))
    order, longest, at = order[by_size], sizes.max(axis=1)[by_size], 0
    while at < len(order):
        # Tracks of up to a quarter more places are padded together.
        n = MOST_PAIRS
        while n > 1 and (at + n > len(order) or n * longest[at : at + n].max() > MOST_PLACES or longest[at : at + n].max() > 64 + 1.25 * longest[at : at + n].min()):
            n //= 2
        some = order[at : at + n]
        p, q = _padded([ones[i] for i in pairs[some, 0]]), _padded([twos[j] for j in pairs[some, 1]])
        # A little above the square, so that rounding leaves nothing out; the caller compares the distances.
        bound = None if within is None else np.full(len(some), within * within * (1 + 1e-9))
        found[some] = np.sqrt(_squares(p, q, bound))
        at += n
    return found


def _tracks(side: pa.ChunkedArray, by: str) -> tuple[pa.Array, list[np.ndarray]]:
    """The animals and the places (2, length) of a side's only row."""
    held = side.combine_chunks()
    held = held.flatten() if not isinstance(held, pa.ChunkedArray) else held.chunk(0).flatten()
    fields = dict(zip([f.name for f in held.type], held.flatten()))
    points = fields["points"]
    places = dict(zip([f.name for f in points.values.type], points.values.flatten()))
    xy = np.stack([places[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y")])
    ends = points.offsets.to_numpy()
    return fields[by], [xy[:, a:b] for a, b in zip(ends[:-1], ends[1:])]


def _of_blocks(group: list[str], by: str, within: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        (a, ones), (b, twos) = _tracks(left["l1"], by), _tracks(right["l2"], by)
        if left["b1"][0] == left["b2"][0]:
            # Both sides are one block; their order may differ.
            b, twos = a, ones
            pairs = np.stack(np.triu_indices(len(ones), 1), axis=1)
        else:
            pairs = np.stack([v.ravel() for v in np.indices((len(ones), len(twos)))], axis=1)
        far = distances(ones, twos, pairs, within)
        if within is not None:
            pairs, far = pairs[far <= within], far[far <= within]
        first = pa.array(np.zeros(len(pairs), np.int64))
        columns = [left[g].take(first) for g in group] + [a.take(pa.array(pairs[:, 0])), b.take(pa.array(pairs[:, 1])), pa.array(far, pa.float64())]
        return pa.table(columns, [*group, "_one", "_two", "frechet"])

    return found


def frechet_pairs(fixes: DataFrame, group: list[str], within: float | None = None, by: str = "animal_id") -> DataFrame:
    """(*group, a, b, frechet) of every two animals of a group, or of those at most ``within`` apart.

    With a bound, pairs whose lower bound (``least_possible``) is beyond it fill no table, and a table is left once a diagonal has no cell within it.
    """
    made = lines(fixes, [*group, by]).filter(F.col(by).isNotNull())
    left, right = _halves(made, group, by, BLOCK)
    key = [*group, "b1", "b2"]
    kinds = StructType([left.schema[g] for g in group] + [StructField(c, made.schema[by].dataType) for c in ("_one", "_two")] + [StructField("frechet", DoubleType())])
    right = right.toDF(*right.columns)  # columns of its own: both sides read one table
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_of_blocks(group, by, within), kinds)
    return found.select(*group, F.least("_one", "_two").alias("a"), F.greatest("_one", "_two").alias("b"), "frechet")


def mean_frechet(fixes: DataFrame, group: list[str], by: str = "animal_id") -> DataFrame:
    """How alike the ways of a group were: (*group, pairs, mean_frechet). Groups of one animal have no row."""
    found = frechet_pairs(fixes, group, by=by)
    return found.groupBy(*group).agg(F.count(F.lit(1)).alias("pairs"), F.avg("frechet").alias("mean_frechet"))
