"""SQL building blocks of the equivalent queries: named CTEs and formulas."""

from __future__ import annotations

import re

from checks import data

M = data.MAX_SPEED
SEG = "event_id, breed, animal_id, session_id, time, hour, nsat, x, y"


def secs(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 1e6)"


def dist(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"sqrt(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"


def rounded_time(seconds: str) -> str:
    return f"make_timestamp(cast(floor({seconds} + 0.5) as bigint) * 1000000)"


def cross(ax: str, ay: str, bx: str, by: str) -> str:
    return f"(({ax}) * ({by}) - ({ay}) * ({bx}))"


def meets(a: tuple, b: tuple) -> str:
    """Closed segment test by sides and boxes."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    bdx, bdy, adx, ady = f"{bx2} - {bx1}", f"{by2} - {by1}", f"{ax2} - {ax1}", f"{ay2} - {ay1}"
    return (
        f"({ax2} is not null and least({ax1}, {ax2}) <= greatest({bx1}, {bx2}) and least({bx1}, {bx2}) <= greatest({ax1}, {ax2})"
        f" and least({ay1}, {ay2}) <= greatest({by1}, {by2}) and least({by1}, {by2}) <= greatest({ay1}, {ay2})"
        f" and {cross(bdx, bdy, f'{ax1} - {bx1}', f'{ay1} - {by1}')} * {cross(bdx, bdy, f'{ax2} - {bx1}', f'{ay2} - {by1}')} <= 0"
        f" and {cross(adx, ady, f'{bx1} - {ax1}', f'{by1} - {ay1}')} * {cross(adx, ady, f'{bx2} - {ax1}', f'{by2} - {ay1}')} <= 0)"
    )


def beta_series(a: str, b: str, y: str) -> str:
    """The regularised incomplete beta function I_y(a, b) as a power series; good where y is not near 1."""
    front = f"exp({a} * ln({y}) + {b} * ln(1 - {y}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}))"
    term = f"exp(lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({y}))"
    return f"case when {y} <= 0 then 0.0 else {front} * list_sum(list_transform(range(0, 4000), lambda i: {term})) end"


def gamma_series(a: str, x: str) -> str:
    """The regularised lower incomplete gamma function P(a, x) as a power series."""
    return f"list_sum(list_transform(range(0, 5000), lambda i: exp(({a} + i) * ln({x}) - {x} - lgamma({a} + 1 + i))))"


OWN = ("x", "y", "x2", "y2")
GATE = ("gx1", "gy1", "gx2", "gy2")


def upright(x: int) -> tuple:
    return (f"{float(x)}", f"{float(data.GATE_SOUTH)}", f"{float(x)}", f"{float(data.GATE_NORTH)}")


def point_line(x: str, y: str, x1: str, y1: str, x2: str, y2: str) -> str:
    dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
    t = (
        f"least(1.0::double, greatest(0.0::double, coalesce((({x} - {x1}) * {dx} + ({y} - {y1}) * {dy})"
        f" / nullif({dx} * {dx} + {dy} * {dy}, 0), 0)))"
    )
    return dist(x, y, f"({x1} + {t} * {dx})", f"({y1} + {t} * {dy})")


def lon(x: str, y: str) -> str:
    p, q = f"(({x} - 2600000.0::double) / 1000000.0::double)", f"(({y} - 1200000.0::double) / 1000000.0::double)"
    return (
        f"((2.6779094::double + 4.728982::double * {p} + 0.791484::double * {p} * {q} + 0.1306::double * {p} * {q} * {q}"
        f" - 0.0436::double * {p} * {p} * {p}) * 100.0::double / 36.0::double)"
    )


def lat(x: str, y: str) -> str:
    p, q = f"(({x} - 2600000.0::double) / 1000000.0::double)", f"(({y} - 1200000.0::double) / 1000000.0::double)"
    return (
        f"((16.9023892::double + 3.238272::double * {q} - 0.270978::double * {p} * {p} - 0.002528::double * {q} * {q}"
        f" - 0.0447::double * {p} * {p} * {q} - 0.0140::double * {q} * {q} * {q}) * 100.0::double / 36.0::double)"
    )


CTES: dict[str, str] = {
    "tracks": data.TRACKS_SQL.format(events="events"),
    "raw": data.RAW_SQL.format(events="events"),
    "good": "select * from tracks where nsat >= 4",
    "gates": f"""
select r.route, cast(g.no as int) as gate_no, {data.START_X}.0::double + {data.END_X - data.START_X}.0::double * g.no / 6.0::double as gx1,
  {data.GATE_SOUTH}.0::double as gy1, {data.START_X}.0::double + {data.END_X - data.START_X}.0::double * g.no / 6.0::double as gx2,
  {data.GATE_NORTH}.0::double as gy2
from range(7) g(no), (values ('trail'), ('road')) r(route)""",
    "ways": f"""
select route, 2780000.0::double + 100.0::double * s as x1, y::double as y1, 2780000.0::double + 100.0::double * (s + 1) as x2, y::double as y2
from range(14) t(s), (values ('trail', {data.TRAIL_Y}), ('road', {data.ROAD_Y})) r(route, y)""",
}


def _pass(src: str, p: str) -> None:
    track = "window w as (partition by session_id, animal_id order by time, event_id)"
    CTES[f"{p}_a"] = (
        f"select {SEG}, lead(time) over w as time2, lead(x) over w as x2, lead(y) over w as y2 from {src} {track}"
    )
    CTES[f"{p}_b"] = f"select *, {secs('time', 'time2')} as timelag, {dist('x', 'y', 'x2', 'y2')} as steplength from {p}_a"
    CTES[f"{p}_c"] = (
        "select *, case when timelag = 0 then case when steplength > 0 then cast('inf' as double) end"
        f" else steplength / timelag end as speed from {p}_b"
    )
    CTES[f"{p}_d"] = f"select *, lag(speed) over w as speed_in from {p}_c {track}"
    CTES[p] = f"select {SEG} from {p}_d where coalesce(speed < {M}, true) and coalesce(speed_in < {M}, true)"


PASSES = 5
for i in range(1, PASSES + 1):
    _pass("good" if i == 1 else f"p{i - 1}", f"p{i}")

CTES["segs"] = f"select * from p{PASSES}_c"
CTES["met"] = f"""
select *, {meets(OWN, upright(data.START_X))} as cs, {meets(OWN, upright(data.END_X))} as ce from segs"""
CTES["ev0"] = """
select *, cs and lead(ce, 1, false) over w as out_start, ce and lead(cs, 1, false) over w as back_start
from met where cs or ce window w as (partition by session_id, animal_id order by time, event_id)"""
CTES["ev"] = """
select *, lag(out_start, 1, false) over w as out_end, lag(back_start, 1, false) over w as back_end
from ev0 window w as (partition by session_id, animal_id order by time, event_id)"""
CTES["win"] = """
select session_id, min(time) filter (out_start) as out_from, max(time) filter (out_end) as out_to,
  min(time) filter (back_start) as back_from, max(time) filter (back_end) as back_to from ev group by session_id"""
CTES["whole"] = """
select session_id, animal_id, bool_or(out_start) as out_complete, bool_or(back_start) as back_complete from ev group by all"""
CTES["flagged"] = """
select s.*, coalesce(time >= out_from - interval 2 minute and time <= out_to + interval 2 minute, false) as on_out,
  coalesce(time >= back_from - interval 2 minute and time <= back_to + interval 2 minute, false) as on_back
from segs s left join win using (session_id)"""
CTES["labelled"] = """
select * exclude (on_out, on_back), case when on_out and not on_back then 'out' when on_back and not on_out then 'back' end as direction
from flagged where on_out or on_back"""
CTES["trips0"] = """
select l.* from labelled l join whole using (session_id, animal_id)
where (direction = 'out' and out_complete) or (direction = 'back' and back_complete)"""
CTES["waydist"] = f"""
select event_id, session_id, direction, route, min({point_line('x', 'y', 'x1', 'y1', 'w.x2', 'w.y2')}) as dist
from (select event_id, session_id, direction, x, y from trips0 where x > {data.START_X} and x < {data.END_X}) t, ways w group by all"""
CTES["assigned"] = """
select session_id, direction, mt as mean_dist_trail, mr as mean_dist_road, case when mt < mr then 'trail' else 'road' end as route
from (select session_id, direction, avg(dist) filter (route = 'trail') as mt, avg(dist) filter (route = 'road') as mr
  from waydist group by all)"""
CTES["trips"] = "select t.*, a.route from trips0 t left join assigned a using (session_id, direction)"
_cut = f"({cross('gx1 - x', 'gy1 - y', 'gx2 - gx1', 'gy2 - gy1')} / {cross('x2 - x', 'y2 - y', 'gx2 - gx1', 'gy2 - gy1')})"
CTES["hits0"] = f"""
select t.*, gate_no, x + {_cut} * (x2 - x) as cut_x, y + {_cut} * (y2 - y) as cut_y
from trips t join gates g using (route) where {meets(OWN, GATE)}"""
CTES["hits"] = f"""
select *, {dist('x', 'y', 'cut_x', 'cut_y')} / nullif(steplength, 0) as share,
  {rounded_time(f"epoch_us(time) / 1e6 + ({dist('x', 'y', 'cut_x', 'cut_y')} / nullif(steplength, 0)) * timelag")} as crossing_time
from hits0"""
CTES["cr"] = """
select session_id, animal_id, direction, route, gate_no, crossing_time, breed, day_part from (
  select *, substring(session_id, 7, 1) as day_part, row_number() over (partition by session_id, animal_id, direction, route, gate_no
    order by crossing_time nulls last, time, event_id) as rn from hits) where rn = 1"""
CTES["ranked"] = """
select *, rank() over (partition by route, session_id, direction, gate_no order by crossing_time)
  + (count(*) over (partition by route, session_id, direction, gate_no, crossing_time) - 1) / 2.0 as rank,
  (epoch_us(crossing_time) - epoch_us(min(crossing_time) over (partition by route, session_id, direction, gate_no))) / 1e6 as gap
from cr where crossing_time is not null"""
CTES["lead_at"] = """
select session_id, direction, gate_no, crossing_time as ref_time, animal_id as leader_id from (
  select *, row_number() over (partition by session_id, direction, gate_no order by crossing_time, animal_id) as rn
  from cr where crossing_time is not null) where rn = 1"""
CTES["last_fix"] = """
select * from (
  select l.session_id, l.direction, l.gate_no, l.ref_time, t.* exclude (session_id, direction),
    row_number() over (partition by l.session_id, l.direction, l.gate_no, t.animal_id order by t.time desc, t.event_id) as rn
  from lead_at l join trips t on t.session_id = l.session_id and t.direction = l.direction and t.time <= l.ref_time) where rn = 1"""
CTES["pos"] = f"""
select session_id, direction, gate_no, ref_time, animal_id, event_id, {secs('time', 'ref_time')} / nullif(timelag, 0) as share,
  x + ({secs('time', 'ref_time')} / nullif(timelag, 0)) * (x2 - x) as px, y + ({secs('time', 'ref_time')} / nullif(timelag, 0)) * (y2 - y) as py
from last_fix"""
CTES["near"] = f"""
select p.session_id, p.direction, p.gate_no, p.animal_id as a, q.animal_id as b, {dist('p.px', 'p.py', 'q.px', 'q.py')} as dist
from pos p join pos q on p.session_id = q.session_id and p.direction = q.direction and p.gate_no = q.gate_no and p.animal_id < q.animal_id
where {dist('p.px', 'p.py', 'q.px', 'q.py')} <= 5"""
CTES["herd"] = "select distinct animal_id from pos"
CTES["prox"] = "select a, b, count(*) as n from near group by all"
CTES["pairs"] = """
select p.animal_id as a, q.animal_id as b, coalesce(n, 0) as n,
  case when regexp_extract(p.animal_id, '^[A-Z]+') = regexp_extract(q.animal_id, '^[A-Z]+') then 1 else 0 end as same_breed,
  case when regexp_extract(p.animal_id, '^[A-Z]+') = regexp_extract(q.animal_id, '^[A-Z]+') then 'same breed' else 'different breed' end as pair_type
from herd p join herd q on p.animal_id < q.animal_id left join prox on prox.a = p.animal_id and prox.b = q.animal_id"""
# Order of arrival per gate without the route, for the rank tests.
CTES["arrival"] = """
select *, rank() over (partition by session_id, direction, gate_no order by crossing_time)
  + (count(*) over (partition by session_id, direction, gate_no, crossing_time) - 1) / 2.0 as rank
from cr where crossing_time is not null"""
CTES["pooled"] = """
select animal_id as grp, rank as value, rank() over (order by rank) + (count(*) over (partition by rank) - 1) / 2.0 as r from arrival"""
CTES["kw"] = """
select n, k, (b - n * (n + 1) * (n + 1) / 4.0) / s2 as h, s2 from (
  select sum(n) as n, count(*) as k, sum(rs * rs / n) as b from (select grp, count(*) as n, sum(r) as rs from pooled group by grp)),
  (select (sum(r * r) - count(*) * (count(*) + 1.0) * (count(*) + 1.0) / 4.0) / (count(*) - 1) as s2 from pooled)"""

# Clusters of snapshots, replayed as lists: hash-drawn starts, steps to standstill, the best restart and k.
# ``lloyd`` refers to itself; a query that uses it starts with "with recursive".
SNAP = "session_id, direction, gate_no"
_apart = "(p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)"
_squares = f"list_transform(centres, lambda c: {_apart})"
_of = "list_filter(pts, lambda p, i: lab[i] = j)"
CTES["snaps"] = f"""
select {SNAP}, pts, n, list_sum(list_transform(pts, lambda p: (p.x - mx) * (p.x - mx) + (p.y - my) * (p.y - my))) as sst from (
  select {SNAP}, list(struct_pack(id := animal_id, x := px, y := py) order by animal_id) as pts, count(*) as n, avg(px) as mx, avg(py) as my
  from pos where px is not null and py is not null group by all having count(*) >= 3)"""
CTES["dealt"] = f"""
select {SNAP}, n, run, list_sort(list_transform(pts, lambda p: struct_pack(
  key := md5(concat_ws('|', '73', run::varchar, p.id, session_id, direction, gate_no::varchar)), id := p.id, x := p.x, y := p.y))) as deck
from snaps, range(100) r(run)"""
CTES["lloyd"] = f"""
select {SNAP}, k, run, list_sort(list_transform(deck[1:k], lambda p: struct_pack(x := p.x, y := p.y))) as centres, true as go
from dealt, range(2, 7) c(k) where k < n
union all
select {SNAP}, k, run, moved, list_max(list_transform(range(1, k + 1), lambda j:
  greatest(abs(moved[j].x - centres[j].x), abs(moved[j].y - centres[j].y)))) > 1e-6 as go
from (select *, list_transform(range(1, k + 1), lambda j: case when list_contains(lab, j) then struct_pack(
    x := round(list_avg(list_transform({_of}, lambda p: p.x)), 6), y := round(list_avg(list_transform({_of}, lambda p: p.y)), 6)) else centres[j] end) as moved
  from (select {SNAP}, k, run, centres, pts, list_transform(pts, lambda p: list_position({_squares}, list_min({_squares}))) as lab
    from lloyd join snaps using ({SNAP}) where go))"""
CTES["settled"] = f"""
select {SNAP}, k, n, run, centres, round(coalesce(list_sum(list_transform(pts, lambda p: list_min({_squares}))) / nullif(sst, 0), 0), 9) as rest
from lloyd join snaps using ({SNAP}) where not go"""
CTES["by_k"] = f"""
select *, coalesce(((1 - rest) / (k - 1)) / nullif(rest / (n - k), 0), cast('inf' as double)) as score from (
  select *, row_number() over (partition by {SNAP}, k order by rest, run) as rn from settled) where rn = 1"""
CTES["clustered"] = f"""
select {SNAP}, p.id as animal_id, p.x as px, p.y as py, k, list_position({_squares}, list_min({_squares})) as cluster from (
  select {SNAP}, k, list_sort(centres) as centres, unnest(pts) as p
  from (select *, row_number() over (partition by {SNAP} order by score desc, k) as best from by_k) join snaps using ({SNAP}) where best = 1)"""


def sql(final: str) -> str:
    """``final`` with the CTEs it names, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\b[a-z_0-9]+\b", re.sub(r"'[^']*'", "", text))):
            if word in CTES and word not in needed:
                needed.add(word)
                visit(CTES[word])

    visit(final)
    heads = [f"{name} as materialized ({body.strip()})" for name, body in CTES.items() if name in needed]
    body = final.strip()
    for word in ("with recursive ", "with "):  # the query brings CTEs of its own
        if body.startswith(word):
            return f"{word}{', '.join(heads)}, {body.removeprefix(word)}" if heads else body
    return (f"with {', '.join(heads)} " if heads else "") + body
