"""Leaders and followers, likeness of ways, moving time windows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks import data
from checks.registry import query
from checks.sqltext import dist
from trackflow.operators import following, frechet, movement

# --- leaders and followers. The derived tracks have few fixes, so ticks are long and the cone is wide.
TICK_S, NEAR, CONE, TURN, LEAST = 1800, 150.0, 180.0, 90.0, 2
HALF_COS, TURN_COS = repr(math.cos(math.radians(CONE / 2))), repr(math.cos(math.radians(TURN)))

TICKS = f"""(select session_id, tick, animal_id, x as px, y as py, (x2 - x) / steplength as ux, (y2 - y) / steplength as uy from (
    select *, row_number() over (partition by session_id, tick, animal_id order by time, event_id) as rn
    from (select *, floor(epoch_us(time) / {TICK_S}e6)::bigint as tick from segs)) where rn = 1 and steplength > 0)"""
FOLLOW = f"""(select session_id, tick, leader, follower, dist from (
    select l.session_id, l.tick, l.animal_id as leader, f.animal_id as follower, {dist("f.px", "f.py", "l.px", "l.py")} as dist,
      (l.px - f.px) * f.ux + (l.py - f.py) * f.uy as ahead, l.ux * f.ux + l.uy * f.uy as same
    from {TICKS} l join {TICKS} f on l.session_id = f.session_id and l.tick = f.tick and l.animal_id <> f.animal_id)
  where dist > 0 and dist <= {NEAR} and ahead >= {HALF_COS}::double * dist and same >= {TURN_COS}::double)"""


def islands(source: str, keys: str) -> str:
    return f"""(select {keys}, run_no, count(*) as ticks, min(tick) as from_tick, max(tick) as to_tick from (
      select {keys}, tick, sum(new) over (partition by {keys} order by tick) as run_no from (
        select {keys}, tick, case when tick = lag(tick) over (partition by {keys} order by tick) + 1 then 0 else 1 end as new from {source}))
    group by {keys}, run_no having count(*) >= {LEAST})"""


def relation(spark, sf_dir):
    moving = following.headings(data.study(spark, sf_dir).segments, TICK_S)
    return following.materialise(following.follows(moving, NEAR, CONE, TURN))


@query("x8_follows", f"select session_id, tick, leader, follower, round(dist, 4) as dist from {FOLLOW}")
def x8_follows(spark, sf_dir):
    return relation(spark, sf_dir).withColumn("dist", F.round("dist", 4))


@query(
    "x8_leader_follower",
    f"select session_id, leader, follower, run_no::bigint as run_no, ticks, from_tick, to_tick from {islands(FOLLOW, 'session_id, leader, follower')}",
)
def x8(spark, sf_dir):
    return following.follow_runs(relation(spark, sf_dir), LEAST)


LEADING = f"""(select session_id, tick, leader as animal_id from {FOLLOW} group by session_id, tick, leader having count(*) >= 1
  except select session_id, tick, follower from {FOLLOW})"""


@query(
    "x8_time_led",
    f"""select animal_id, count(distinct session_id) as sessions, count(*) as times, (sum(ticks) * {TICK_S})::bigint as led_s, (max(ticks) * {TICK_S})::bigint as longest_s
      from {islands(LEADING, 'session_id, animal_id')} group by animal_id""",
)
def x8_time(spark, sf_dir):
    return following.time_led(relation(spark, sf_dir), 1, LEAST, TICK_S)


# --- likeness of ways


def frechet_sql(source: str, group: str, final: str) -> str:
    """Discrete Fréchet distance of every two animals per group as a recursion over anti-diagonals."""
    keys = [k.strip() for k in group.split(",")]
    same = " and ".join(f"o.{k} = t.{k}" for k in keys)
    own = ", ".join(f"o.{k} as {k}" for k in keys)
    gap = "(q[k - i + 2].x - p[i].x) * (q[k - i + 2].x - p[i].x) + (q[k - i + 2].y - p[i].y) * (q[k - i + 2].y - p[i].y)"
    return f"""with recursive lines as materialized (
      select {group}, animal_id, list(struct_pack(x := x, y := y) order by time, event_id) as pts from {source} group by {group}, animal_id),
    f as (
      select {own}, o.animal_id as a, t.animal_id as b, o.pts as p, t.pts as q, 0 as k, [case when i = 1 then
          (t.pts[1].x - o.pts[1].x) * (t.pts[1].x - o.pts[1].x) + (t.pts[1].y - o.pts[1].y) * (t.pts[1].y - o.pts[1].y) else 'inf'::double end for i in range(1, len(o.pts) + 1)] as cur,
        ['inf'::double for i in o.pts] as old
      from lines o join lines t on {same} and o.animal_id < t.animal_id
      union all
      select {group}, a, b, p, q, k, [case when k - i + 2 between 1 and len(q) then greatest({gap},
          least(cur[i], case when i > 1 then cur[i - 1] else 'inf'::double end, case when i > 1 then old[i - 1] else 'inf'::double end)) else 'inf'::double end
        for i in range(1, len(p) + 1)], cur
      from (select * replace (k + 1 as k) from f where k + 2 < len(p) + len(q))),
    d as (select {group}, a, b, sqrt(cur[len(p)]) as frechet from f where k + 2 = len(p) + len(q))
    {final}"""


@query("x11_frechet", frechet_sql("segs", "session_id", "select session_id, a, b, round(frechet, 4) as frechet from d"))
def x11(spark, sf_dir):
    """Whole tracks of a session."""
    found = frechet.frechet_pairs(data.study(spark, sf_dir).segments, ["session_id"])
    return found.withColumn("frechet", F.round("frechet", 4))


@query("x11_frechet_within", frechet_sql("segs", "session_id", "select session_id, a, b, round(frechet, 4) as frechet from d where frechet <= 250.0"))
def x11_within(spark, sf_dir):
    found = frechet.frechet_pairs(data.study(spark, sf_dir).segments, ["session_id"], within=250.0)
    return found.withColumn("frechet", F.round("frechet", 4))


@query(
    "x11_mean_frechet",
    frechet_sql(
        "trips", "session_id, direction", "select session_id, direction, count(*) as pairs, round(avg(frechet), 4) as mean_frechet from d group by session_id, direction"
    ),
)
def x11_mean(spark, sf_dir):
    """Trips of one session and direction."""
    found = frechet.mean_frechet(data.study(spark, sf_dir).trips, ["session_id", "direction"])
    return found.withColumn("mean_frechet", F.round("mean_frechet", 4))


# --- moving time window


def window_sql(seconds: int) -> str:
    frame = f"(partition by session_id, animal_id order by time range between interval {seconds} seconds preceding and interval {seconds} seconds following)"
    return f"""select event_id, round(way / nullif(lag_s, 0), 9) as moving_speed from (
      select event_id, sum(coalesce(steplength, 0)) over w as way, sum(coalesce(timelag, 0)) over w as lag_s from segs window w as {frame})"""


@query("x4_moving_speed_60s", window_sql(60))
def x4_60s(spark, sf_dir):
    speed = movement.moving_speed_within(data.study(spark, sf_dir).segments, 60)
    return speed.select("event_id", F.round("moving_speed", 9).alias("moving_speed"))


@query("x4_moving_speed_hour", window_sql(3600))
def x4_hour(spark, sf_dir):
    """A window wider than a chunk."""
    speed = movement.moving_speed_within(data.study(spark, sf_dir).segments, 3600)
    return speed.select("event_id", F.round("moving_speed", 9).alias("moving_speed"))
