"""Leaders and followers against a search over all pairs and moments."""

import math
import random

import pytest

from trackflow.operators import following, network


def relation_brute(rows, metres, cone, turn):
    """rows: (session, tick, animal, px, py, ux, uy)"""
    found = set()
    for s, t, a, ax, ay, aux, auy in rows:
        for s2, t2, b, bx, by, bux, buy in rows:
            if (s, t) != (s2, t2) or a == b or aux is None or bux is None:
                continue
            dx, dy = ax - bx, ay - by
            far = math.sqrt(dx * dx + dy * dy)
            ahead = dx * bux + dy * buy >= math.cos(math.radians(cone / 2)) * far
            if 0 < far <= metres and ahead and aux * bux + auy * buy >= math.cos(math.radians(turn)):
                found.add((s, t, a, b))
    return found


def runs_brute(ticks, least):
    runs, now = [], []
    for t in sorted(ticks):
        if now and t != now[-1] + 1:
            runs.append(now)
            now = []
        now = [*now, t]
    runs += [now] if now else []
    return [(i, len(r), r[0], r[-1]) for i, r in enumerate(runs, 1) if len(r) >= least]


def moving(r, animals, ticks):
    rows = []
    for s in ("a", "b"):
        for t in range(ticks):
            for i in range(animals):
                if r.random() < 0.8:
                    angle = r.choice([0.0, 0.3, 1.5, 3.0])
                    unit = (math.cos(angle), math.sin(angle)) if r.random() < 0.9 else (None, None)
                    rows.append((s, 1020 + t, f"HO{i:02d}", float(r.randrange(60)), float(r.randrange(10)), *unit))
    return rows


@pytest.mark.parametrize("hot", [1000, 2])
def test_follows_and_runs(spark, monkeypatch, hot):
    monkeypatch.setattr(network, "HOT_GROUP", hot)
    rows = moving(random.Random(hot), 9, 30)
    table = spark.createDataFrame(rows, "session_id string, tick long, animal_id string, px double, py double, ux double, uy double")
    held = following.materialise(following.follows(table, 20.0, 120.0, 60.0))
    want = relation_brute(rows, 20.0, 120.0, 60.0)
    assert {(x["session_id"], x["tick"], x["leader"], x["follower"]) for x in held.collect()} == want and len(want) > 100
    found = following.follow_runs(held, 2).collect()
    by_pair = {}
    for s, t, a, b in want:
        by_pair.setdefault((s, a, b), []).append(t)
    assert {tuple(x) for x in found} == {(*k, *run) for k, ticks in by_pair.items() for run in runs_brute(ticks, 2)}
    followed, behind = {}, {(s, t, b) for s, t, _, b in want}
    for s, t, a, _ in want:
        followed[s, t, a] = followed.get((s, t, a), 0) + 1
    lead = {}
    for (s, t, a), n in followed.items():
        if n >= 2 and (s, t, a) not in behind:
            lead.setdefault((a, s), []).append(t)
    runs = [(a, s, n) for (a, s), ticks in lead.items() for _, n, _, _ in runs_brute(ticks, 1)]
    times = {x["animal_id"]: (x["sessions"], x["times"], x["led_s"], x["longest_s"]) for x in following.time_led(held, 2, 1, 20).collect()}
    assert times == {
        a: (len({s for b, s, _ in runs if b == a}), sum(b == a for b, _, _ in runs), 20 * sum(n for b, _, n in runs if b == a), 20 * max(n for b, _, n in runs if b == a))
        for a in {a for a, _, _ in runs}
    }


def test_headings(spark, fixes):
    from trackflow.operators import trajectory

    segs = trajectory.segments(fixes([("s", "HO01", "10:00:00", 0, 0), ("s", "HO01", "10:00:09", 3, 4), ("s", "HO01", "10:00:20", 3, 4), ("s", "HO02", "10:00:05", 9, 9)]))
    got = {(r["animal_id"], r["tick"] % 3): (r["px"], r["py"], r["ux"], r["uy"]) for r in following.headings(segs, 20).collect()}
    first = min(k[1] for k in got if k[0] == "HO02")
    assert got["HO01", first] == (0.0, 0.0, 0.6, 0.8)
    assert got["HO01", (first + 1) % 3] == (3.0, 4.0, None, None) and got["HO02", first] == (9.0, 9.0, None, None)
    assert following.follows(following.headings(segs.limit(0)), 5.0, 90.0, 90.0).collect() == []
