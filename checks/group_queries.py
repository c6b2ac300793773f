"""Appending and reshaping, statistics, clusters, network and movement measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import data
from checks.registry import query
from checks.sqltext import beta_series, dist, gamma_series, secs
from trackflow.functions.columns import parse_source_columns
from trackflow.operators import clusters, crossings, movement, network, routes, snapshots, stats, trips
from trackflow.operators.tables import materialise
from trackflow.sources.tracks import append_by_name

# --- set operations and reshaping


@query(
    "j1_append_by_name",
    "select event_id, animal_id, cast(null as varchar) as time_text from tracks union all select event_id, null, time_text from raw",
)
def j1(spark, sf_dir):
    both = [data.tracks(spark, sf_dir).select("event_id", "animal_id"), data.raw_fixes(spark, sf_dir).select("time_text", "event_id")]
    return append_by_name(both)


@query(
    "j2_pair_matrix",
    """select p.animal_id, q.animal_id as other, coalesce((select max(n) from prox where (a = p.animal_id and b = q.animal_id)
      or (a = q.animal_id and b = p.animal_id)), 0)::bigint as n from herd p, herd q""",
)
def j2(spark, sf_dir):
    """The matrix's cells; its own columns are named after the herd."""
    study = data.study(spark, sf_dir)
    matrix = network.pair_matrix(study.proximity, study.animals)
    return matrix.unpivot("animal_id", [c for c in matrix.columns if c != "animal_id"], "other", "n")


@query("j3_matrix_to_pairs", "select a, b, n::bigint as n, same_breed, pair_type from pairs")
def j3(spark, sf_dir):
    study = data.study(spark, sf_dir)
    return network.matrix_to_pairs(network.pair_matrix(study.proximity, study.animals))


# --- counts and network


@query("g10_proximity_counts", "select a, b, n::bigint as n from pairs")
def g10(spark, sf_dir):
    study = data.study(spark, sf_dir)
    return network.with_zero_pairs(study.proximity, study.animals)


# Labels that plain SQL can make too: the third of the way an animal is on.
THIRDS = "(select session_id, direction, gate_no, animal_id, px, py, cast(floor((px - 2780000.0::double) / 500.0::double) as int) as cluster from pos where px is not null)"


def thirds(spark, sf_dir):
    pos = data.study(spark, sf_dir).positions.filter(F.col("px").isNotNull())
    return materialise(pos.withColumn("cluster", F.floor((F.col("px") - 2780000.0) / 500.0).cast("int")))


@query(
    "g9_co_cluster_counts",
    f"""select p.animal_id as a, q.animal_id as b, count(*) as n from {THIRDS} p join {THIRDS} q using (session_id, direction, gate_no, cluster)
      where p.animal_id < q.animal_id group by all""",
)
def g9(spark, sf_dir):
    return network.co_cluster_counts(thirds(spark, sf_dir))


@query(
    "g9_co_cluster_counts_of_clusters",
    """with recursive together as (select p.animal_id as a, q.animal_id as b, count(*) as n from clustered p
        join clustered q using (session_id, direction, gate_no, cluster) where p.animal_id < q.animal_id group by all)
      select p.animal_id as a, q.animal_id as b, coalesce(n, 0)::bigint as n from herd p join herd q on p.animal_id < q.animal_id
      left join together t on t.a = p.animal_id and t.b = q.animal_id""",
)
def g9_clusters(spark, sf_dir):
    study = data.study(spark, sf_dir)
    return network.with_zero_pairs(network.co_cluster_counts(study.clusters), study.animals)


@query(
    "f7_same_snapshot_pairs",
    """select p.session_id, p.direction, p.gate_no, p.cluster, count(*) as pairs from (select session_id, direction, gate_no, cluster, p.animal_id as a, q.animal_id as b
      from THIRDS p join THIRDS q using (session_id, direction, gate_no, cluster) where p.animal_id < q.animal_id) p group by all""".replace("THIRDS", THIRDS),
)
def f7(spark, sf_dir):
    on = ["session_id", "direction", "gate_no", "cluster"]
    labels = thirds(spark, sf_dir)
    here = labels.select(*on, F.col("animal_id").alias("a"))
    there = labels.select(*on, F.col("animal_id").alias("b"))
    pairs = network.group_join(here, there, on, F.col("a") < F.col("b"))
    return pairs.groupBy(*on).agg(F.count(F.lit(1)).alias("pairs"))


@query(
    "g11_box_by_animal",
    """select animal_id, n, mean, q1, median, q3, whisker_low, whisker_high from (
      select animal_id, count(*) as n, round(avg(rank), 4) as mean, any_value(q1) as q1, any_value(median) as median, any_value(q3) as q3,
        min(rank) filter (rank >= q1 - (q3 - q1) * 1.5 and rank <= q3 + (q3 - q1) * 1.5) as whisker_low,
        max(rank) filter (rank >= q1 - (q3 - q1) * 1.5 and rank <= q3 + (q3 - q1) * 1.5) as whisker_high
      from arrival join (select animal_id, quantile_cont(rank, 0.25) as q1, quantile_cont(rank, 0.5) as median, quantile_cont(rank, 0.75) as q3
        from arrival group by animal_id) using (animal_id) group by animal_id)""",
)
def g11_animal(spark, sf_dir):
    return stats.box_summary(arrival(spark, sf_dir), "rank", ["animal_id"]).withColumn("mean", F.round("mean", 4))


def box_sql(source: str, value: str, by: str) -> str:
    inside = f"{value} >= q1 - (q3 - q1) * 1.5 and {value} <= q3 + (q3 - q1) * 1.5"
    return f"""select {by}, count(*) as n, round(avg({value}), 4) as mean, round(any_value(q1), 4) as q1, round(any_value(median), 4) as median,
      round(any_value(q3), 4) as q3, round(min({value}) filter ({inside}), 4) as whisker_low, round(max({value}) filter ({inside}), 4) as whisker_high
      from {source} join (select {by}, quantile_cont({value}, 0.25) as q1, quantile_cont({value}, 0.5) as median, quantile_cont({value}, 0.75) as q3
      from {source} group by {by}) using ({by}) group by {by}"""



def rounded_box(df):
    return df.withColumns({k: F.round(k, 4) for k in ("mean", "q1", "median", "q3", "whisker_low", "whisker_high")})


FAR = f"(select breed, {dist('x', 'y', '2780425.0::double', '1161875.0::double')} as dist_to_ref from tracks)"


@query("g11_box_by_breed", box_sql(FAR, "dist_to_ref", "breed"))
def g11_breed(spark, sf_dir):
    from trackflow.functions.geometry import distance

    far = distance(F.col("x"), F.col("y"), F.lit(2780425.0), F.lit(1161875.0))
    return rounded_box(stats.box_summary(data.tracks(spark, sf_dir).withColumn("dist_to_ref", far), "dist_to_ref", ["breed"]))


@query("g11_box_by_pair_type", box_sql("(select pair_type, n::double as meetings from pairs)", "meetings", "pair_type"))
def g11_pairs(spark, sf_dir):
    return rounded_box(stats.box_summary(data.study(spark, sf_dir).pairs, "n", ["pair_type"]))


@query(
    "g12_edge_width",
    "select a, b, n::bigint as n, round(n / (select max(n) from prox)::double * 8.0, 6) as width from prox",
)
def g12(spark, sf_dir):
    return network.edge_list(data.study(spark, sf_dir).pairs, 8.0).select("a", "b", "n", F.round("width", 6).alias("width"))


@query("m1_edge_list", "select a, b, n::bigint as n, same_breed from pairs where n > 0")
def m1(spark, sf_dir):
    return network.edge_list(data.study(spark, sf_dir).pairs, 10.0).select("a", "b", "n", "same_breed")


@query("m1_nodes", "select animal_id, regexp_extract(animal_id, '^[A-Z]+') as breed from herd")
def m1_nodes(spark, sf_dir):
    return network.nodes(data.study(spark, sf_dir).animals)


@query("k8_same_breed", "select a, b, same_breed from pairs")
def k8(spark, sf_dir):
    return data.study(spark, sf_dir).pairs.select("a", "b", "same_breed")


# --- statistics


def arrival(spark, sf_dir):
    return materialise(crossings.rank_at_gates(data.study(spark, sf_dir).crossings, ["session_id", "direction", "gate_no"]))


@query("k1_kruskal_wallis", "select n::bigint as n, k, round(h, 4) as h, k - 1 as df from kw")
def k1(spark, sf_dir):
    return stats.kruskal_wallis(arrival(spark, sf_dir), "rank", "animal_id").select("n", "k", F.round("h", 4).alias("h"), "df")


@query(
    "k1_kruskal_wallis_p",
    f"select n::bigint as n, k, round(h, 4) as h, k - 1 as df, round(greatest(0, 1 - {gamma_series('((k - 1) / 2.0)', '(h / 2.0)')}), 6) as p from kw",
)
def k1_p(spark, sf_dir):
    tested = stats.kruskal_wallis(arrival(spark, sf_dir), "rank", "animal_id")
    return tested.withColumns({"h": F.round("h", 4), "p": F.round("p", 6)})


@query(
    "k1_kruskal_wallis_p_of_quantity",
    f"""select n::bigint as n, k, round(1 - {gamma_series('((k - 1) / 2.0)', '(h / 2.0)')}, 6) as p from (select n, k, (b - n * (n + 1.0) * (n + 1.0) / 4.0) / s2 as h from (
      select sum(n) as n, count(*) as k, sum(rs * rs / n) as b from (select l_linenumber, count(*) as n, sum(r) as rs from R group by 1)),
      (select (sum(r * r) - count(*) * (count(*) + 1.0) * (count(*) + 1.0) / 4.0) / (count(*) - 1) as s2 from R))""".replace(
        "R",
        "(select l_linenumber, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as r from lineitem)",
    ),
)
def k1_p_quantity(spark, sf_dir):
    """A test of groups that hardly differ, so p is not near 0."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", "l_quantity")
    return stats.kruskal_wallis(items, "l_quantity", "l_linenumber").select("n", "k", F.round("p", 6).alias("p"))


@query(
    "k1_kruskal_wallis_quantity",
    """select n::bigint as n, k, round((b - n * (n + 1.0) * (n + 1.0) / 4.0) / s2, 3) as h, k - 1 as df from (
      select sum(n) as n, count(*) as k, sum(rs * rs / n) as b from (select l_returnflag, count(*) as n, sum(r) as rs from R group by 1)),
      (select (sum(r * r) - count(*) * (count(*) + 1.0) * (count(*) + 1.0) / 4.0) / (count(*) - 1) as s2 from R)""".replace(
        "R",
        "(select l_returnflag, rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as r from lineitem)",
    ),
)
def k1_quantity(spark, sf_dir):
    """The same test on a table of many rows and few distinct values."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity")
    return stats.kruskal_wallis(items, "l_quantity", "l_returnflag").select("n", "k", F.round("h", 3).alias("h"), "df")


POSTHOC = """(select a.grp as a, b.grp as b, a.m as mean_a, b.m as mean_b, a.m - b.m as diff,
  (a.m - b.m) / sqrt(s2 * (n - 1 - h) / (n - k) * (1.0 / a.c + 1.0 / b.c)) as t, (n - k)::double as df
  from (select grp, count(*) as c, sum(r) / count(*) as m from pooled group by grp) a
  join (select grp, count(*) as c, sum(r) / count(*) as m from pooled group by grp) b on a.grp < b.grp, kw)"""


@query(
    "k2_posthoc_t",
    f"select a, b, round(diff, 4) as diff, round(t, 6) as t, df from {POSTHOC}",
)
def k2(spark, sf_dir):
    tested = stats.posthoc(arrival(spark, sf_dir), "rank", "animal_id")
    return tested.select("a", "b", F.round("diff", 4).alias("diff"), F.round("t", 6).alias("t"), "df")


TESTED = f"""(select *, least(1.0, min(q) over (order by p desc range between unbounded preceding and current row)) as p_adj from (
  select *, p * (count(*) over ())::double / (count(*) over (order by p range between unbounded preceding and current row)) as q from (
    select *, greatest(0.0, 1 - {beta_series("0.5", "(df / 2.0)", "y")}) as p from (select *, t * t / (df + t * t) as y from {POSTHOC}))))"""


@query(
    "k2_posthoc_p",
    f"""select a, b, round(mean_a, 4) as mean_a, round(mean_b, 4) as mean_b, round(diff, 4) as diff, round(t, 6) as t, df, round(p, 6) as p, round(p_adj, 6) as p_adj
      from {TESTED}""",
)
def k2_p(spark, sf_dir):
    tested = stats.posthoc(arrival(spark, sf_dir), "rank", "animal_id")
    return tested.withColumns({c: F.round(c, n) for c, n in (("mean_a", 4), ("mean_b", 4), ("diff", 4), ("t", 6), ("p", 6), ("p_adj", 6))})


# Values in (0, 1] that stand for p values: exact in both engines.
SHARES = "(select event_id, (k + 1) / 128.0::double as p from (select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events))"


@query(
    "k2_bh_adjust",
    f"""select event_id, p, round(least(1.0, min(q) over (order by p desc range between unbounded preceding and current row)), 9) as p_adj from (
      select event_id, p, p * (count(*) over ())::double / (count(*) over (order by p range between unbounded preceding and current row)) as q from {SHARES})""",
)
def k2_bh(spark, sf_dir):
    held = data.events(spark, sf_dir).select(
        "event_id", ((F.regexp_extract("props", "([0-9]+)", 1).cast("int") + 1) / F.lit(128.0)).alias("p")
    )
    return stats.bh_adjust(held, "p", "p_adj").withColumn("p_adj", F.round("p_adj", 9))


def letters_sql(order: str, tested: str, differs: str, final: str) -> str:
    return f"""with g as (select grp, sum(r) / count(*) as m, row_number() over (order by sum(r) / count(*) {order}, grp) as place from pooled group by grp),
      d as (select least(x.place, y.place) as lo, greatest(x.place, y.place) as hi from {tested} p join g x on x.grp = p.a join g y on y.grp = p.b where {differs}),
      e as (select place, coalesce((select min(hi) from d where lo = place) - 1, (select count(*) from g)) as stop from g),
      s as (select place, min(stop) over (order by place rows between current row and unbounded following) as stop from e),
      f as (select place, stop, max(stop) over (order by place rows between unbounded preceding and 1 preceding) as far from s),
      r as (select place, stop, row_number() over (order by place) as no from f where far is null or stop > far)
      select {final}, string_agg(chr(cast(96 + no as int)), '' order by no) as letters from g join r on g.place between r.place and r.stop group by grp, m"""


@query("k3_letter_groups", letters_sql("desc", POSTHOC, "abs(t) > 2", "grp as animal_id"))
def k3(spark, sf_dir):
    ranks = arrival(spark, sf_dir)
    tested = stats.posthoc(ranks, "rank", "animal_id").withColumn("differs", F.abs("t") > 2)
    means = stats.rank_sums(stats.pooled_ranks(ranks, "rank", "animal_id")).select("group", "mean_rank")
    return stats.letter_groups(means, tested).select(F.col("group").alias("animal_id"), "letters")


# Reversed ranks turn the order of the means round and change no p value.
@query(
    "k3_letter_groups_bh",
    letters_sql("asc", TESTED, "p_adj <= 0.05", 'grp as "group", round((select count(*) from arrival) + 1 - m, 4) as mean_rank'),
)
def k3_bh(spark, sf_dir):
    ranks = stats.reversed_rank(arrival(spark, sf_dir), "rank", "reversed")
    tested = stats.posthoc(ranks, "reversed", "animal_id").withColumn("differs", F.col("p_adj") <= 0.05)
    means = stats.rank_sums(stats.pooled_ranks(ranks, "reversed", "animal_id")).select("group", "mean_rank")
    return stats.letter_groups(means, tested).withColumn("mean_rank", F.round("mean_rank", 4))


@query("k4_effect_size", "select round((h - k + 1) / (n - k), 6) as effect_size from kw")
def k4(spark, sf_dir):
    test = stats.kruskal_wallis(arrival(spark, sf_dir), "rank", "animal_id")
    return stats.epsilon_squared(test).select(F.round("effect_size", 6).alias("effect_size"))


def levene_sql(source: str, value: str, group: str) -> str:
    z = f"(select s.{group} as g, abs(s.{value} - m.med) as z from {source} s join (select {group}, median({value}) as med from {source} group by 1) m on m.{group} = s.{group})"
    return f"""select n, k, round(((gs - s * s / n) / (k - 1)) / ((sq - gs) / (n - k)), 4) as f, k - 1 as df1, n - k as df2 from (
      select sum(n)::bigint as n, count(*) as k, sum(s) as s, sum(s * s / n) as gs, sum(sq) as sq
      from (select g, count(*) as n, sum(z) as s, sum(z * z) as sq from {z} group by g))"""


@query("k5_levene", levene_sql("arrival", "rank", "animal_id"))
def k5(spark, sf_dir):
    return stats.levene(arrival(spark, sf_dir), "rank", "animal_id").select("n", "k", F.round("f", 4).alias("f"), "df1", "df2")


@query("k5_levene_price", levene_sql("lineitem", "l_extendedprice", "l_returnflag"))
def k5_price(spark, sf_dir):
    """Medians and spreads of a column with many distinct values."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_extendedprice")
    out = stats.levene(items, "l_extendedprice", "l_returnflag")
    return out.select("n", "k", F.round("f", 4).alias("f"), "df1", "df2")


@query(
    "k5_levene_p",
    f"""select n, k, round(1 - {beta_series("((k - 1) / 2.0)", "((n - k) / 2.0)", "y")}, 6) as p from (
      select n, k, (k - 1) * f / (n - k + (k - 1) * f) as y from ({levene_sql('lineitem', 'l_quantity', 'l_linenumber').replace(', 4) as f', ', 12) as f')}))""",
)
def k5_p(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", "l_quantity")
    return stats.levene(items, "l_quantity", "l_linenumber").select("n", "k", F.round("p", 6).alias("p"))


@query("k6_group_means", "select animal_id, count(rank) as n, round(avg(rank), 4) as mean from arrival group by animal_id")
def k6(spark, sf_dir):
    return stats.group_means(arrival(spark, sf_dir), "rank", ["animal_id"]).withColumn("mean", F.round("mean", 4))


MOVES = """(select o.perm, o.animal_id, t.animal_id as moved_to from (select perm, animal_id, row_number() over (partition by perm order by
    case when perm = 0 then animal_id else md5('73-' || perm || '-' || animal_id) end, animal_id) as place from herd, range(1000) r(perm)) o
  join (select animal_id, row_number() over (order by animal_id) as place from herd) t using (place))"""


@query("f8_permuted_pairs", f"select perm::int as perm, animal_id, moved_to from {MOVES}")
def f8(spark, sf_dir):
    return stats.permuted_names(data.study(spark, sf_dir).animals, 999, 73)


MANTEL = f"""with m as {MOVES}, r as (select x.perm, corr(q.n::double, p.same_breed::double) as r from pairs p
        join m x on x.animal_id = p.a join m y on y.animal_id = p.b and y.perm = x.perm
        join pairs q on q.a = least(x.moved_to, y.moved_to) and q.b = greatest(x.moved_to, y.moved_to) group by x.perm)
      select case when not isnan(any_value(r0)) then round(any_value(r0), 6) end as r,
        case when not isnan(any_value(r0)) then (count(*) filter (r >= r0 - 1.5e-8) + 1) / 1000.0 end as p,
        999 as permutations from r, (select r as r0 from r where perm = 0) where perm > 0"""


@query("k7_mantel", MANTEL)
def k7(spark, sf_dir):
    return data.study(spark, sf_dir).mantel(999).withColumn("r", F.round("r", 6))


@query("k7_mantel_999", MANTEL)
def k7_full(spark, sf_dir):
    """Two whole matrices: every pair meets every permutation."""
    return stats.mantel(data.study(spark, sf_dir).pairs, "same_breed").withColumn("r", F.round("r", 6))


# --- clusters


@query(
    "l1_snapshot_clusters",
    """with recursive labels as (select * from clustered)
      select session_id, direction, gate_no, animal_id, round(px, 4) as px, round(py, 4) as py, k::int as k, cluster::int as cluster from labels""",
)
def l1(spark, sf_dir):
    labelled = data.study(spark, sf_dir).clusters
    return labelled.withColumns({c: F.round(c, 4) for c in ("px", "py")})


@query(
    "l2_calinski_harabasz",
    f"""select session_id, direction, gate_no, k, n, round((ssb / (k - 1)) / nullif(ssw / nullif(n - k, 0), 0), 2) as score from (
      select session_id, direction, gate_no, count(*) as k, sum(n)::bigint as n, sum(n * ((cx - mx) * (cx - mx) + (cy - my) * (cy - my))) as ssb, sum(ssw) as ssw from (
        select session_id, direction, gate_no, cluster, count(*) as n, avg(px) as cx, avg(py) as cy, any_value(mx) as mx, any_value(my) as my,
          sum((px - lx) * (px - lx) + (py - ly) * (py - ly)) as ssw from (select *, avg(px) over c as lx, avg(py) over c as ly, avg(px) over s as mx, avg(py) over s as my
          from {THIRDS} window c as (partition by session_id, direction, gate_no, cluster), s as (partition by session_id, direction, gate_no)) group by 1, 2, 3, 4)
      group by 1, 2, 3) where k > 1 and n > k""",
)
def l2(spark, sf_dir):
    scored = snapshots.calinski_harabasz(thirds(spark, sf_dir), ["session_id", "direction", "gate_no"])
    kept = scored.filter("k > 1 and n > k")
    return kept.select("session_id", "direction", "gate_no", "k", "n", F.round("score", 2).alias("score"))


# --- movement measures


def weather(spark, sf_dir):
    """Hourly temperatures of a station: a daily course with noise, from the events' counts per hour."""
    hour = F.date_trunc("hour", "ts")
    seen = data.events(spark, sf_dir).groupBy(hour.alias("time")).agg(F.count(F.lit(1)).alias("n"))
    return seen.select("time", (F.lit(24.0) - F.abs(F.hour("time") - 14) + F.col("n") % 5).alias("temp_c"))


WEATHER = "(select date_trunc('hour', ts) as full_hour, 24.0::double - abs(extract(hour from date_trunc('hour', any_value(ts))) - 14) + count(*) % 5 - 6.5::double * (2000.0::double - 1700.0::double) / 1000.0::double as temp_c from events group by 1)"
CATEGORY = "case when temp_c < 16 then 'comfort' when temp_c < 22 then 'warm' when temp_c is not null then 'hot' end"


@query("x1_temperature", f"select event_id, round(temp_c, 6) as temp_c from tracks left join {WEATHER} on full_hour = date_trunc('hour', time)")
def x1(spark, sf_dir):
    timed = movement.temperature_at(data.tracks(spark, sf_dir), weather(spark, sf_dir), "time", 1700.0, 2000.0)
    return timed.select("event_id", F.round("temp_c", 6).alias("temp_c"))


@query("x2_temperature_category", f"select event_id, {CATEGORY} as category from tracks left join {WEATHER} on full_hour = date_trunc('hour', time)")
def x2(spark, sf_dir):
    timed = movement.temperature_at(data.tracks(spark, sf_dir), weather(spark, sf_dir), "time", 1700.0, 2000.0)
    return timed.select("event_id", movement.temperature_category(F.col("temp_c")).alias("category"))


SECTIONS = """(select a.session_id, a.animal_id, a.direction, a.route, a.gate_no as section, least(a.crossing_time, b.crossing_time) as entered,
  abs((epoch_us(b.crossing_time) - epoch_us(a.crossing_time)) / 1e6) as duration_s from cr a join cr b
  on a.session_id = b.session_id and a.animal_id = b.animal_id and a.direction = b.direction and a.route = b.route and b.gate_no = a.gate_no + 1)"""


@query("x3_section_duration", f"select session_id, animal_id, direction, route, section, entered, duration_s from {SECTIONS}")
def x3(spark, sf_dir):
    return movement.section_durations(data.study(spark, sf_dir).crossings)


@query(
    "x3_section_duration_by_temperature",
    f"select section, category, round(avg(duration_s), 4) as mean_s, count(*) as n from (select *, {CATEGORY} as category from {SECTIONS} left join {WEATHER} on full_hour = date_trunc('hour', entered)) group by all",
)
def x3_temperature(spark, sf_dir):
    timed = movement.temperature_at(x3(spark, sf_dir), weather(spark, sf_dir), "entered", 1700.0, 2000.0)
    labelled = timed.withColumn("category", movement.temperature_category(F.col("temp_c")))
    return labelled.groupBy("section", "category").agg(F.round(F.avg("duration_s"), 4).alias("mean_s"), F.count(F.lit(1)).alias("n"))


@query(
    "x4_moving_speed",
    """select event_id, round(way / nullif(lag_s, 0), 9) as moving_speed from (select event_id, sum(coalesce(steplength, 0)) over w as way, sum(coalesce(timelag, 0)) over w as lag_s
      from segs window w as (partition by session_id, animal_id order by time, event_id rows between 2 preceding and 2 following))""",
)
def x4(spark, sf_dir):
    return movement.moving_speed(data.study(spark, sf_dir).segments).select("event_id", F.round("moving_speed", 9).alias("moving_speed"))


STOPS = """(select session_id, animal_id, stop_no, count(*) as fixes, min(time) as stop_from, max(time2) as stop_to from (
  select *, sum(case when slow and not before then 1 else 0 end) over w as stop_no from (
    select *, coalesce(lag(slow) over w, false) as before from (select *, coalesce(speed < 0.05, false) as slow from segs) WIN) WIN)
  where slow group by 1, 2, 3)""".replace("WIN", "window w as (partition by session_id, animal_id order by time, event_id)")


@query(
    "x5_stops",
    f"""select session_id, animal_id, stop_no::bigint as stop_no, fixes, stop_from, stop_to, {secs('stop_from', 'stop_to')} as duration_s,
      {secs('ended', 'stop_from')} as since_last_s from (select *, lag(stop_to) over (partition by session_id, animal_id order by stop_no) as ended from {STOPS})""",
)
def x5(spark, sf_dir):
    return movement.stops(data.study(spark, sf_dir).segments, 0.05)


@query(
    "x6_sinuosity",
    "select session_id, animal_id, direction, route, round(sum(steplength), 4) as walked_m, round(sum(steplength) / any_value(case when route is not null then 1400.0::double end), 6) as sinuosity from trips group by session_id, animal_id, direction, route",
)
def x6(spark, sf_dir):
    out = movement.sinuosity(data.study(spark, sf_dir).trips, data.routes(spark))
    return out.withColumns({"walked_m": F.round("walked_m", 4), "sinuosity": F.round("sinuosity", 6)})


@query(
    "x7_heading",
    "select event_id, case when x <> x2 or y <> y2 then round(case when a < 0 then a + 360 else a end, 6) end as heading from (select *, degrees(atan2(x2 - x, y2 - y)) as a from segs)",
)
def x7(spark, sf_dir):
    turn = movement.heading(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    return data.study(spark, sf_dir).segments.select("event_id", F.round(turn, 6).alias("heading"))


@query(
    "x7_forward_share",
    """select session_id, animal_id, direction, count(*) as moves, round(avg(case when (direction = 'out' and x2 > x) or (direction = 'back' and x2 < x) then 1.0 else 0.0 end), 6) as forward_share
      from trips where steplength > 0 group by all""",
)
def x7_forward(spark, sf_dir):
    study = data.study(spark, sf_dir)
    start, end = routes.gate_lines(study.setting.gates, 0, 6)
    return movement.forward_share(study.trips, start, end).withColumn("forward_share", F.round("forward_share", 6))


@query(
    "x9_mean_pair_distance",
    f"""select session_id, direction, gate_no, animals, round(mean_dist, 4) as mean_dist from (select session_id, direction, gate_no, count(*) as animals from pos where px is not null group by all)
      left join (select p.session_id, p.direction, p.gate_no, avg({dist('p.px', 'p.py', 'q.px', 'q.py')}) as mean_dist from pos p join pos q
        on p.session_id = q.session_id and p.direction = q.direction and p.gate_no = q.gate_no and p.animal_id < q.animal_id where p.px is not null and q.px is not null group by all)
      using (session_id, direction, gate_no)""",
)
def x9(spark, sf_dir):
    return movement.mean_pair_distance(data.study(spark, sf_dir).positions).withColumn("mean_dist", F.round("mean_dist", 4))


# A hull's edge has no place to its right, and none in line with it beyond its ends.
SIDE = "((q.px - p.px) * (r.py - p.py) - (q.py - p.py) * (r.px - p.px))"
BEYOND = "((r.px - p.px) * (q.px - p.px) + (r.py - p.py) * (q.py - p.py) < 0 or (r.px - q.px) * (p.px - q.px) + (r.py - q.py) * (p.py - q.py) < 0)"


@query(
    "x10_hull_area",
    f"""with pts as materialized (select distinct session_id, direction, gate_no, px, py from pos where px is not null and py is not null),
      edges as (select p.session_id, p.direction, p.gate_no, p.px as x1, p.py as y1, q.px as x2, q.py as y2 from pts p join pts q
        on p.session_id = q.session_id and p.direction = q.direction and p.gate_no = q.gate_no and (p.px <> q.px or p.py <> q.py)
        where not exists (select 1 from pts r where r.session_id = p.session_id and r.direction = p.direction and r.gate_no = p.gate_no
          and (r.px <> p.px or r.py <> p.py) and (r.px <> q.px or r.py <> q.py) and ({SIDE} < 0 or ({SIDE} = 0 and {BEYOND}))))
      select session_id, direction, gate_no, greatest(1, count(x1))::int as corners, round(coalesce(sum((x1 - ox) * (y2 - oy) - (y1 - oy) * (x2 - ox)), 0) / 2, 3) as area
      from (select session_id, direction, gate_no, min(px) as ox, min(py) as oy from pts group by all) left join edges using (session_id, direction, gate_no)
      group by session_id, direction, gate_no""",
)
def x10(spark, sf_dir):
    return movement.hull_area(data.study(spark, sf_dir).positions).withColumn("area", F.round("area", 3))


CHANGES = """(select animal_id, direction, session_id, mean_rank, first_time, mean_rank - lag(mean_rank) over (partition by animal_id, direction order by first_time, session_id) as change
  from (select animal_id, direction, session_id, avg(rank) as mean_rank, min(crossing_time) as first_time from ranked group by 1, 2, 3))"""


@query("x12_rank_change", f"select animal_id, direction, session_id, round(mean_rank, 4) as mean_rank, round(change, 4) as change from {CHANGES}")
def x12(spark, sf_dir):
    changed = movement.rank_changes(data.study(spark, sf_dir).ranked).drop("first_time")
    return changed.withColumns({k: F.round(k, 4) for k in ("mean_rank", "change")})


@query(
    "x12_rank_change_by_temperature",
    f"select category, round(avg(abs(change)), 4) as mean_change, count(change) as n from (select *, {CATEGORY} as category from {CHANGES} left join {WEATHER} on full_hour = date_trunc('hour', first_time)) group by all",
)
def x12_temperature(spark, sf_dir):
    changed = movement.rank_changes(data.study(spark, sf_dir).ranked)
    timed = movement.temperature_at(changed, weather(spark, sf_dir), "first_time", 1700.0, 2000.0)
    labelled = timed.withColumn("category", movement.temperature_category(F.col("temp_c")))
    return labelled.groupBy("category").agg(F.round(F.avg(F.abs("change")), 4).alias("mean_change"), F.count("change").alias("n"))
