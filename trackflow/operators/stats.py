"""Rank tests, permutation test and group summaries as aggregates.

Rows are reduced to counts per (group, value) before any rank is taken, and
ranks come from running counts over value ranges, so no step sorts all rows in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackflow.functions.tails import chi2_tail, f_tail, t_two_sided
from trackflow.operators.network import all_pairs
from trackflow.operators.ordered import neighbours, quantiles, running_total, seq_chunk, value_chunk, value_counts
from trackflow.operators.tables import attach, materialise, row_count

# Permutation count and the tolerance for equal correlations.
PERMUTATIONS = 999
SAME_R = 1.5e-8


def reversed_rank(df: DataFrame, rank: str, name: str) -> DataFrame:
    """Largest rank + 1 - rank, so that the first come out on top."""
    top = materialise(df.agg(F.max(rank).alias("_top")).withColumn("_all", F.lit(1)))
    return attach(df.withColumn("_all", F.lit(1)), top, ["_all"]).withColumn(
        name, F.col("_top") + 1 - F.col(rank)
    ).drop("_all", "_top")


def pooled_ranks(df: DataFrame, value: str, group: str) -> DataFrame:
    """Written table (group, value, m, n, rank): counts with pooled mid-ranks."""
    counts = materialise(
        df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(F.col(group).alias("group"), F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("m"))
    )
    ties = materialise(counts.groupBy("value").agg(F.sum("m").alias("n")))
    upto = running_total(ties, [], ["value"], F.col("n"), value_chunk(ties, "value"), "upto")
    mid = F.col("upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
    return materialise(counts.join(upto.select("value", "n", mid.alias("rank")), "value"))


def rank_sums(ranks: DataFrame) -> DataFrame:
    """Per group: size and mean pooled rank."""
    per = ranks.groupBy("group").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("rank")).alias("rank_sum"))
    return per.withColumn("mean_rank", F.col("rank_sum") / F.col("n"))


def _kruskal(ranks: DataFrame) -> DataFrame:
    """One row: n, k, h (tie-corrected), s2 (variance of the ranks)."""
    groups = rank_sums(ranks).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("between"),
    )
    squares = ranks.agg(F.sum(F.col("m") * F.col("rank") * F.col("rank")).alias("squares"))
    both = groups.withColumn("_all", F.lit(1)).join(squares.withColumn("_all", F.lit(1)), "_all").drop("_all")
    n = F.col("n").cast("double")
    centre = n * (n + 1) * (n + 1) / 4
    # Rank variance from the mid-ranks themselves is the tie correction.
    s2 = (F.col("squares") - centre) / F.when(n > 1, n - 1)
    return both.select("n", "k", ((F.col("between") - centre) / F.when(s2 > 0, s2)).alias("h"), s2.alias("s2"))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: n, k, h, df, p."""
    tested = _kruskal(pooled_ranks(df, value, group))
    tested = tested.withColumn("df", F.col("k") - 1)
    return tested.withColumn("p", chi2_tail(F.col("h"), F.col("df"))).select("n", "k", "h", "df", "p")


def epsilon_squared(test: DataFrame) -> DataFrame:
    """Adds the effect size (h - k + 1) / (n - k) to a Kruskal-Wallis row."""
    size = F.try_divide(F.col("h") - F.col("k") + 1, (F.col("n") - F.col("k")).cast("double"))
    return test.withColumn("effect_size", size)


def posthoc(df: DataFrame, value: str, group: str) -> DataFrame:
    """Every two groups: difference of mean ranks, t, two-sided p, BH-adjusted p.

    The t statistic is Conover's on the pooled ranks: its variance is
    s2 * (n - 1 - h) / (n - k).
    """
    ranks = pooled_ranks(df, value, group)
    sums = materialise(rank_sums(ranks))
    total = materialise(_kruskal(ranks).withColumn("_all", F.lit(1)))
    names = sums.select(F.col("group").alias("animal_id"))
    left = sums.select(F.col("group").alias("a"), F.col("n").alias("n_a"), F.col("mean_rank").alias("mean_a"))
    right = sums.select(F.col("group").alias("b"), F.col("n").alias("n_b"), F.col("mean_rank").alias("mean_b"))
    pairs = attach(attach(all_pairs(names), left, ["a"]), right, ["b"])
    whole = attach(pairs.withColumn("_all", F.lit(1)), total, ["_all"])
    freedom = (F.col("n") - F.col("k")).cast("double")
    mse = F.col("s2") * (F.col("n") - 1 - F.col("h")) / F.when(freedom > 0, freedom)
    spread = F.sqrt(mse * (1 / F.col("n_a") + 1 / F.col("n_b")))
    diff = F.col("mean_a") - F.col("mean_b")
    out = whole.select(
        "a", "b", "mean_a", "mean_b", diff.alias("diff"), F.try_divide(diff, spread).alias("t"), freedom.alias("df")
    )
    return bh_adjust(out.withColumn("p", t_two_sided(F.col("t"), F.col("df"))), "p", "p_adj")


def bh_adjust(df: DataFrame, p: str, name: str) -> DataFrame:
    """Benjamini-Hochberg: least of p * m / rank over all not smaller p, at most 1."""
    df = materialise(df)
    counts = materialise(value_counts(df, [], p))
    size = df.filter(F.col(p).isNotNull()).count()
    raw = counts.withColumn("_q", F.col(p) * F.lit(float(size)) / F.col("upto")).withColumn("_down", -F.col(p))
    least = running_total(raw, [], ["_down"], F.col("_q"), -value_chunk(counts, p), "_least", F.min)
    adjusted = materialise(least.select(p, F.least(F.lit(1.0), F.col("_least")).alias(name)))
    return attach(df, adjusted, [p])


def letter_groups(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Letters so that groups sharing one do not differ; a is the best (highest) mean.

    ``groups`` has (group, mean_rank), ``pairs`` (a, b, differs). Along the
    order of means, every longest stretch in which no member differs from
    another gets a letter. Returns (group, mean_rank, letters).
    """
    order = ["_down", "group"]
    keyed = materialise(groups.select("group", "mean_rank", (-F.col("mean_rank")).alias("_down")))
    chunk = value_chunk(keyed, "_down")
    placed = materialise(running_total(keyed, [], order, F.lit(1).cast("bigint"), chunk, "place"))
    place = placed.select(F.col("group").alias("_g"), F.col("place").alias("_p"))
    apart = pairs.filter("differs")
    one = attach(apart, place.select(F.col("_g").alias("a"), F.col("_p").alias("pa")), ["a"])
    two = attach(one, place.select(F.col("_g").alias("b"), F.col("_p").alias("pb")), ["b"])
    stop = two.groupBy(F.least("pa", "pb").alias("place")).agg((F.min(F.greatest("pa", "pb")) - 1).alias("_stop"))
    size = row_count(placed)
    reach = placed.join(stop, "place", "left").withColumn("_stop", F.coalesce("_stop", F.lit(size)))
    reach = reach.select("place", "_stop", (F.lit(size) - F.col("place")).alias("_back"))
    # A stretch also ends before the first place from which any later member of it differs.
    least = running_total(reach, [], ["_back"], F.col("_stop"), seq_chunk("_back"), "_least", F.min)
    reach = materialise(least.select("place", F.col("_least").alias("_stop")))
    furthest = running_total(reach, [], ["place"], F.col("_stop"), seq_chunk("place"), "_far", F.max)
    before = neighbours(furthest, [], ["place"], {"_far_before": ("_far", -1)}, seq_chunk("place"))
    fresh = before.filter(F.col("_far_before").isNull() | (F.col("_stop") > F.col("_far_before")))
    runs = running_total(materialise(fresh.select("place", "_stop")), [], ["place"], F.lit(1).cast("bigint"), seq_chunk("place"), "_no")
    members = runs.withColumn("place", F.explode(F.sequence("place", "_stop"))).select("place", "_no")
    index = F.col("_no") - 1
    letter = F.when(index < 26, F.char(index + 97)).otherwise(F.concat(F.char(index % 26 + 97), F.floor(index / 26).cast("string")))
    named = members.withColumn("_l", F.struct(F.col("_no"), letter.alias("l")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("_l")), lambda s: s["l"]), "")
    letters = materialise(named.groupBy("place").agg(joined.alias("letters")))
    return attach(placed, letters, ["place"]).select("group", "mean_rank", "letters")


def group_means(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: equality of spread, from distances to each group's median. n, k, f, df1, df2, p."""
    held = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("group"), F.col(value).cast("double").alias("value"))
    centre = materialise(quantiles(held, ["group"], "value", {"median": 0.5}))
    z = F.abs(F.col("value") - F.col("median"))
    far = attach(held, centre, ["group"]).select("group", z.alias("z"))
    per = far.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("sq"))
    share = F.col("s") * F.col("s") / F.col("n")
    whole = per.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum("s").alias("s"),
        F.sum(share).alias("group_sq"),
        F.sum("sq").alias("sq"),
    )
    between = F.try_divide(F.col("group_sq") - F.col("s") * F.col("s") / F.col("n"), F.col("k") - 1)
    within = F.try_divide(F.col("sq") - F.col("group_sq"), F.col("n") - F.col("k"))
    # Spread between groups but none within is infinitely clear.
    ratio = F.when((within == 0) & (between > 0), F.lit(float("inf"))).otherwise(F.try_divide(between, within))
    out = whole.select(
        "n", "k", ratio.alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2")
    )
    return out.withColumn("p", f_tail(F.col("f"), F.col("df1"), F.col("df2")))


def box_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group: n, mean, quartiles, and the extreme values within 1.5 box lengths."""
    held = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    box = materialise(quantiles(held, by, "_v", {"q1": 0.25, "median": 0.5, "q3": 0.75}))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return attach(held, box, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_v").alias("mean"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
    )


def permuted_names(animals: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(perm, animal_id, moved_to): perm 0 is the identity, others order by an md5 draw."""
    perms = F.explode(F.sequence(F.lit(0), F.lit(permutations)))
    drawn = animals.select("animal_id", perms.alias("perm"))
    key = F.when(F.col("perm") == 0, F.col("animal_id")).otherwise(
        F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("perm").cast("string"), F.col("animal_id")))
    )
    # One window group is one shuffling of the matrix rows, n_animals long.
    place = F.row_number().over(Window.partitionBy("perm").orderBy("_key", "animal_id"))
    placed = drawn.withColumn("_key", key).withColumn("_place", place)
    own = F.row_number().over(Window.partitionBy("perm").orderBy("animal_id"))
    target = placed.withColumn("_place", own).select("perm", "_place", F.col("animal_id").alias("moved_to"))
    return placed.join(target, ["perm", "_place"]).select("perm", "animal_id", "moved_to")


def mantel(pairs: DataFrame, other: str, permutations: int = PERMUTATIONS, seed: int = 73) -> DataFrame:
    """Correlation of two pair matrices and its permutation p: (r, p, permutations).

    ``pairs`` holds every pair once: a, b, n and the column ``other``, whose
    rows and columns are permuted together.
    """
    pairs = materialise(pairs.select("a", "b", F.col("n").cast("double").alias("n"), F.col(other).cast("double").alias("v")))
    animals = pairs.select(F.col("a").alias("animal_id")).union(pairs.select(F.col("b").alias("animal_id"))).distinct()
    moves = materialise(permuted_names(animals, permutations, seed))
    first = pairs.select("a", "b", "v").join(
        moves.select("perm", F.col("animal_id").alias("a"), F.col("moved_to").alias("a2")), "a"
    )
    second = first.join(moves.select("perm", F.col("animal_id").alias("b"), F.col("moved_to").alias("b2")), ["perm", "b"])
    moved = second.select("perm", F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"), "v")
    met = moved.join(pairs.select("a", "b", "n"), ["a", "b"]).groupBy("perm")
    # A matrix without spread has no correlation (NULL), and then no p.
    r = F.try_divide(F.covar_pop("n", "v"), F.stddev_pop("n") * F.stddev_pop("v"))
    return _permutation_p(materialise(met.agg(r.alias("r"))), permutations)


def _permutation_p(per: DataFrame, permutations: int) -> DataFrame:
    """(r, p, permutations) of correlations (perm, r), written; perm 0 is the one seen."""
    seen = per.filter("perm = 0").select(F.lit(1).alias("_all"), F.col("r").alias("r0"))
    drawn = attach(per.filter("perm > 0").withColumn("_all", F.lit(1)), seen, ["_all"])
    high = F.count(F.when(F.col("r") >= F.col("r0") - SAME_R, 1))
    p = F.when(F.max("r0").isNotNull(), (high + 1) / F.lit(permutations + 1.0))
    return drawn.agg(F.max("r0").alias("r"), p.alias("p")).withColumn("permutations", F.lit(permutations))


def mantel_of_labels(edges: DataFrame, nodes: DataFrame, permutations: int = PERMUTATIONS, seed: int = 73) -> DataFrame:
    """``mantel`` of pair counts against the matrix of equal labels, from the edges alone: (r, p, permutations).

    ``edges`` holds the pairs (a, b, n) with n other than 0, each once; ``nodes`` all animals (animal_id, label). A null label equals none.
    Moving the labels changes neither sums nor squares of both matrices, only what edges of equal labels weigh. Each animal
    carries the labels that all permutations give it as one array, so pairs that never met take no part and an edge
    meets its permutations inside its row.
    """
    held = materialise(nodes.select("animal_id", "label").distinct())
    moves = permuted_names(held.select("animal_id"), permutations, seed)
    given = moves.join(held, "animal_id").groupBy("moved_to").agg(F.array_sort(F.collect_list(F.struct("perm", "label"))).alias("g"))
    given = materialise(given.select("moved_to", F.transform("g", lambda e: e["label"]).alias("labels")))
    counted = materialise(edges.select("a", "b", F.col("n").cast("double").alias("n")).filter("n != 0"))
    one = attach(counted, given.select(F.col("moved_to").alias("a"), F.col("labels").alias("la")), ["a"], "inner")
    two = attach(one, given.select(F.col("moved_to").alias("b"), F.col("labels").alias("lb")), ["b"], "inner")
    every = F.sequence(F.lit(0), F.lit(permutations))
    equal = F.filter(every, lambda i: F.get("la", i) == F.get("lb", i))
    weighed = two.select(F.explode(equal).alias("perm"), "n").groupBy("perm").agg(F.sum("n").alias("nv"))
    perms = held.sparkSession.range(permutations + 1).select(F.col("id").cast("int").alias("perm"), F.lit(1).alias("_all"))
    size = held.agg(F.count(F.lit(1)).cast("double").alias("c")).withColumn("_all", F.lit(1))
    groups = held.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("m"))
    whole = size.join(groups.agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) / 2), F.lit(0.0)).alias("v")).withColumn("_all", F.lit(1)), "_all")
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("sn"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0)).alias("nn")).withColumn("_all", F.lit(1))
    total = materialise(whole.join(sums, "_all"))
    met = attach(perms.join(weighed, "perm", "left"), total, ["_all"])
    pairs = F.col("c") * (F.col("c") - 1) / 2
    spread = (pairs * F.col("nn") - F.col("sn") * F.col("sn")) * (pairs * F.col("v") - F.col("v") * F.col("v"))
    # A matrix without spread has no correlation (NULL), and then no p.
    r = (pairs * F.coalesce("nv", F.lit(0.0)) - F.col("sn") * F.col("v")) / F.when(spread > 0, F.sqrt(spread))
    return _permutation_p(materialise(met.select("perm", r.alias("r"))), permutations)
