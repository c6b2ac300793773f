"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words. Sources, in order of code points with null last, get the weights
5, 2, 1, repeating, and share all words by weight; a target stops at three times its source's size, and the excess is
shared again by weight until none is above.

Document rates stay as close to 1 as the targets allow: they minimise the relative entropy to the corpus
under one constraint per source, the sum of rate * size. The dual has one variable per source; its solution tilts rates
exponentially, rate = min(3, exp(lambda * size / mean size)). Newton steps, kept within a bracket, solve all
sources' duals at once; a step is one aggregation over counted (source, size) pairs. Sums are whole
numbers, so they do not depend on the order of rows, and reruns agree.

Rates become copies: floor(rate + u) with u from a hash of doc_id and size. A shift per source of u, found in two passes
of sums over bins, then brings the words taken to the target as near as whole documents allow.

Defined results: a null or empty text has size 0; a null source is a source; rows that repeat get the same copies;
a source without words has target 0, and its documents are taken once, with no words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackflow.operators.tables import materialise, row_count

WEIGHTS = (5, 2, 1)
MOST = 3
SOURCES_PER_TASK = 50_000
BINS = 4096
UNIT = 1 << 20  # sums are kept in millionths or so
STEPS = 80


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with their place in code point order, null last, without one task for all."""
    parts = max(1, math.ceil(row_count(sources) / SOURCES_PER_TASK))
    ranged = sources.repartitionByRange(parts, F.col("source").isNull(), "source").withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged)
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    before = [F.lit(sum(n for q, n in sizes.items() if q < p)) for p in range(max(sizes, default=0) + 1)]
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").isNull(), "source"))
    return ranged.withColumn("place", F.element_at(F.array(*before), F.col("_part") + 1) + inside - 1).drop("_part")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size; written) with weight and target."""
    weighed = _numbered(sources)
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = materialise(weighed.withColumn("weight", F.element_at(cycle, F.pmod("place", F.lit(len(weights))).cast("int") + 1)).drop("place"))
    total = weighed.agg(F.sum("source_size")).head()[0] or 0
    full = F.lit(False)
    level, open_weight = 0.0, None
    while True:
        sums = weighed.filter(~full).agg(F.sum("weight"), F.sum("source_size")).head()
        if not sums[0] or sums[0] == open_weight:
            break
        open_weight = sums[0]
        closed = weighed.filter(full).agg(F.sum("source_size")).head()[0] or 0
        level = (total - most * closed) / open_weight
        full = F.col("weight") * level > F.col("source_size") * most
    target = F.least(F.col("weight") * F.lit(float(level)), F.col("source_size").cast("double") * most)
    return weighed.withColumn("target", target)


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(tilt * size / mean, F.lit(50.0))))


def tilts(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (source, source_size, n, target) with tilt, the dual's solution.

    ``counted``: (source, size, n). A source that is to be taken three times as a whole has no tilt.
    """
    mean = (F.col("source_size") / F.col("n")).alias("mean")
    goal = F.round(F.col("target") / (F.col("source_size") / F.col("n")) * UNIT).cast("decimal(38,0)")
    open_ = (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * MOST)
    start = F.log(F.greatest(F.col("target") / F.col("source_size"), F.lit(1e-9)))
    state = materialise(
        wanted.filter(open_).select("source", mean, goal.alias("goal"), start.alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"))
    )
    sized = counted.filter("size > 0")
    for _ in range(STEPS):
        joined = sized.join(state.filter("NOT done"), sized["source"].eqNullSafe(state["source"])).drop(state["source"])
        part = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        whole = lambda x: F.sum(F.round(x * UNIT).cast("decimal(28,0)") * F.col("n"))
        sums = joined.groupBy("source").agg(
            whole(part * rate).alias("have"), whole(F.when(rate < MOST, part * part * rate).otherwise(0)).alias("slope")
        )
        gap = F.col("have") - F.col("goal")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap.cast("double") / F.col("slope").cast("double")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        middle = F.when(F.col("low") <= -1e6, F.col("high") * F.when(F.col("high") < 0, 2).otherwise(0) - 1)
        middle = middle.when(F.col("high") >= 1e6, F.col("low") * F.when(F.col("low") > 0, 2).otherwise(0) + 1)
        middle = middle.otherwise((F.col("low") + F.col("high")) / 2)
        near = F.abs(gap.cast("double")) <= F.col("goal").cast("double") * 1e-7
        moved = state.join(sums, state["source"].eqNullSafe(sums["source"]), "left").drop(sums["source"])
        moved = moved.withColumns({"low": low, "high": high, "next": F.when(inside, newton).otherwise(middle)})
        settled = F.col("done") | F.coalesce(near, F.lit(True)) | (F.col("high") - F.col("low") < 1e-12)
        state = materialise(
            moved.select("source", "mean", "goal", F.when(settled, F.col("tilt")).otherwise(F.col("next")).alias("tilt"), "low", "high", settled.alias("done"))
        )
        if state.filter("NOT done").isEmpty():
            break
    found = state.select(F.col("source").alias("_source"), "tilt")
    return wanted.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _copies(shift: Column | float) -> Column:
    """Copies from rate and u; sources without a tilt are whole or empty."""
    raised = F.floor(F.col("rate") + F.col("u") + shift)
    return F.when(F.col("size") == 0, 1).when(F.col("tilt").isNull(), MOST).otherwise(F.greatest(F.lit(0), F.least(F.lit(MOST), raised))).cast("long")


def _shifts(rated: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, shift): what to add to every u of a source so that its words come nearest to its target."""
    part = F.col("rate") + F.col("u") - F.floor(F.col("rate") + F.col("u"))
    base = F.floor(F.col("rate") + F.col("u"))
    rows = rated.filter(F.col("tilt").isNotNull() & (F.col("size") > 0)).withColumns({"part": part, "base": base})
    taken = rows.groupBy("source").agg(F.sum(_copies(0.0) * F.col("size")).alias("taken"))
    aim = taken.join(wanted.select(F.col("source").alias("_source"), "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    aim = materialise(aim.select(F.col("source").alias("_source"), (F.col("target") - F.col("taken")).alias("lack"), F.lit(0).alias("bin"), F.lit(0.0).alias("passed")))
    for level in (1, 2):
        met = rows.join(aim, F.col("source").eqNullSafe(F.col("_source")))
        up = F.col("lack") > 0
        distance = F.when(up, 1 - F.col("part")).otherwise(F.col("part"))
        can = F.when(up, F.col("base") < MOST).otherwise(F.col("base") > 0)
        fine = F.floor(distance * (BINS**level)).cast("long")
        if level == 2:
            can = can & (F.floor(distance * BINS) == F.col("bin"))
        sums = met.filter(can).groupBy("_source", "lack", "passed", fine.alias("fine")).agg(F.sum("size").alias("words"))
        along = Window.partitionBy("_source").orderBy("fine").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("upto", F.col("passed") + F.sum("words").over(along)).withColumn("want", F.abs("lack"))
        if level == 1:
            # The bin in which the running sum passes what is wanted, and the sum before it.
            hit = run.filter(F.col("upto") >= F.col("want")).groupBy("_source", "lack").agg(F.min_by(F.struct("fine", (F.col("upto") - F.col("words")).alias("before")), "fine").alias("hit"))
            aim = materialise(hit.select("_source", "lack", F.col("hit.fine").alias("bin"), F.col("hit.before").cast("double").alias("passed")))
        else:
            none = aim.select("_source", "lack", "passed", F.lit(None).cast("long").alias("fine"), F.lit(None).cast("long").alias("words"), F.col("passed").alias("upto"), F.abs("lack").alias("want"))
            ends = run.select(*none.columns).unionByName(none)
            off = F.abs(F.col("upto") - F.col("want"))
            best = ends.groupBy("_source", "lack").agg(F.min_by(F.struct("fine"), F.struct(off, F.coalesce("fine", F.lit(-1)))).alias("best"))
            best = best.join(aim.select(F.col("_source").alias("_s"), "bin"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
            # Bins up to and with ``fine`` flip; with none chosen, those before the coarse bin.
            edge = F.coalesce((F.col("best.fine") + 1) / F.lit(float(BINS**2)), F.col("bin") / F.lit(float(BINS)))
            tiny = F.lit(0.25 / BINS**2)
            shift = F.when(F.col("lack") > 0, edge - tiny).otherwise(-edge + tiny)
            return materialise(best.select(F.col("_source"), F.when(edge > 0, shift).otherwise(0.0).alias("shift")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, size, source_size, target, rate, copies): each row of ``docs`` as a struct, and its share in the mix."""
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words(text).alias("size"))
    slim = materialise(sized)
    counted = materialise(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = materialise(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")))
    wanted = materialise(tilts(counted, materialise(targets(sources))))
    named = wanted.select(F.col("source").alias("_source"), "source_size", "n", "target", "tilt")

    def rated(rows: DataFrame) -> DataFrame:
        met = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        u = (F.xxhash64("doc_id", "size") / float(1 << 63) + 1) / 2
        rate = F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNull(), float(MOST))
        rate = rate.otherwise(_rate(F.round("tilt", 9), F.col("size"), F.col("source_size") / F.col("n")))
        return met.withColumns({"u": u, "rate": rate})

    shifts = _shifts(rated(slim), wanted).withColumnRenamed("_source", "_shifted")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        words(text).alias("size"),
    )
    final = rated(whole).join(shifts, F.col("source").eqNullSafe(F.col("_shifted")), "left")
    copies = _copies(F.coalesce("shift", F.lit(0.0))).alias("copies")
    return final.select("row", "size", "source_size", "target", "rate", copies)


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it has copies."""
    found = mix(docs, doc_id, text, source).filter("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
