"""Fréchet distances against the recursive definition, and windows of time against all rows."""

import math
import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackflow.operators import frechet
from trackflow.operators.ordered import within_time


def frechet_brute(p, q):
    @lru_cache(None)
    def c(i, j):
        d = math.dist(p[i], q[j])
        if i and j:
            return max(d, min(c(i - 1, j), c(i, j - 1), c(i - 1, j - 1)))
        return max(d, c(i - 1, j)) if i else max(d, c(i, j - 1)) if j else d

    return c(len(p) - 1, len(q) - 1)


def walk(r, n):
    x, y, out = 0.0, 0.0, []
    for _ in range(n):
        if r.random() < 0.8:
            x, y = x + r.randrange(-2, 5), y + r.randrange(-3, 4)
        out.append((x, y))
    return out


@pytest.mark.parametrize("block", [2, 16])
def test_frechet(spark, fixes, block):
    r = random.Random(block)
    walks = {("s" if i < 7 else "t", f"HO{i:02d}"): walk(r, r.choice([1, 2, 5, 23, 40])) for i in range(12)}
    rows = [(s, a, f"10:{i // 60:02d}:{i % 60:02d}", x, y) for (s, a), w in walks.items() for i, (x, y) in enumerate(w)]
    made = frechet.lines(fixes(rows), ["session_id", "animal_id"])
    got = frechet.line_pairs(made, ["session_id"], block=block)
    found = got.select("session_id", "one.animal_id", F.col("two.animal_id").alias("b"), frechet.discrete_frechet(F.col("one.points"), F.col("two.points")).alias("f"), frechet.least_possible(F.col("one"), F.col("two")).alias("low")).collect()
    want = {(s, a, b): frechet_brute(tuple(p), tuple(q)) for (s, a), p in walks.items() for (z, b), q in walks.items() if s == z and a < b}
    assert {(x["session_id"], x["animal_id"], x["b"]): x["f"] for x in found} == pytest.approx(want)
    assert len(found) == len(want) and all(x["low"] <= x["f"] + 1e-9 for x in found)
    limit = sorted(want.values())[len(want) // 2]
    near = frechet.frechet_pairs(fixes(rows), ["session_id"], within=limit).collect()
    assert {(x["session_id"], x["a"], x["b"]) for x in near} == {k for k, v in want.items() if v <= limit}
    mean = {x["session_id"]: (x["pairs"], x["mean_frechet"]) for x in frechet.mean_frechet(fixes(rows), ["session_id"]).collect()}
    own = [v for k, v in want.items() if k[0] == "s"]
    assert mean["s"] == (len(own), pytest.approx(sum(own) / len(own)))


def test_frechet_long_tracks(spark, fixes):
    r = random.Random(3)
    a, b = walk(r, 400), walk(r, 350)
    rows = [("s", n, f"{10 + i // 3600}:{i // 60 % 60:02d}:{i % 60:02d}", x, y) for n, w in (("HO01", a), ("HO02", b)) for i, (x, y) in enumerate(w)]
    best = [[0.0] * len(b) for _ in a]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            come = [best[u][v] for u, v in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if u >= 0 and v >= 0]
            best[i][j] = max(math.dist(p, q), min(come)) if come else math.dist(p, q)
    assert frechet.frechet_pairs(fixes(rows), ["session_id"]).head()["frechet"] == pytest.approx(best[-1][-1])


def test_long_ways_to_and_fro_fill_little_of_the_table(monkeypatch):
    """Tracks that go to and fro ten times as often take about ten times the cells, not a hundred times."""
    filled = []
    gap2 = frechet._gap2
    monkeypatch.setattr(frechet, "_gap2", lambda dx, dy: (filled.append(dx.size if dx.ndim == 2 else 0), gap2(dx, dy))[1])

    def cells(trips):
        r = random.Random(trips)
        ways = [np.array([[700 * abs(1 - i % 40 / 20), r.randrange(9)] for i in range(40 * trips)]).T for _ in range(3)]
        filled.clear()
        got = frechet.distances(ways, ways, np.array([(0, 1), (0, 2), (1, 2)]))
        return sum(filled), ways, got

    few, ways, got = cells(5)
    assert list(got) == pytest.approx([frechet_brute(*(tuple(map(tuple, ways[i].T.tolist())) for i in ij)) for ij in ((0, 1), (0, 2), (1, 2))])
    assert cells(50)[0] < 20 * few


@pytest.mark.parametrize("within", [None, 3.0, 9.0])
def test_distances_of_odd_tracks(within):
    """Lengths from one place on, far tracks, and places that are no number."""
    r = random.Random(7)
    ways = [np.array(walk(r, n), float).T for n in (1, 1, 2, 3, 30, 31, 90, 200, 33)]
    ways[8][0] += 1e6
    pairs = np.array([(i, j) for i in range(9) for j in range(i + 1, 9)])
    got = frechet.distances(ways, ways, pairs, within)
    want = [frechet_brute(*(tuple(map(tuple, ways[i].T.tolist())) for i in ij)) for ij in pairs]
    near = [within is None or w <= within for w in want]
    assert [g for g, b in zip(got, near) if b] == pytest.approx([w for w, b in zip(want, near) if b])
    assert not any(g <= within for g, b in zip(got, near) if not b)
    ways[5][1, 3] = math.nan
    lost = frechet.distances(ways, ways, np.array([(4, 5), (4, 6)]))
    assert math.isnan(lost[0]) and lost[1] == pytest.approx(want[pairs.tolist().index([4, 6])])


def test_more_blocks_than_tracks(spark, fixes, monkeypatch):
    """Blocks by places: some have no track; a session without a name has no pairs."""
    monkeypatch.setattr(frechet, "BLOCK_POINTS", 8)
    r = random.Random(4)
    walks = {f"HO{i:02d}": walk(r, 20 + i) for i in range(6)}
    rows = [(s, a, f"10:00:{i:02d}", x, y) for s in ("s", None) for a, w in walks.items() for i, (x, y) in enumerate(w)]
    got = frechet.frechet_pairs(fixes(rows), ["session_id"]).collect()
    want = {("s", a, b): frechet_brute(tuple(p), tuple(q)) for a, p in walks.items() for b, q in walks.items() if a < b}
    assert len(got) == len(want) and {(x["session_id"], x["a"], x["b"]): x["frechet"] for x in got} == pytest.approx(want)


def test_too_long_tracks_are_an_error(spark, fixes, monkeypatch):
    monkeypatch.setattr(frechet, "MAX_POINTS", 2)
    rows = [("s", a, f"10:00:0{i}", i, 0) for a in ("HO01", "HO02") for i in range(3)]
    with pytest.raises(Exception, match="more than 2 places"):
        frechet.frechet_pairs(fixes(rows), ["session_id"]).collect()
    still = [("s", a, f"10:00:0{i}", 1, 0) for a in ("HO01", "HO02") for i in range(3)]
    assert frechet.frechet_pairs(fixes(still), ["session_id"]).head()["frechet"] == 0.0


@pytest.mark.parametrize("before, after, chunk", [(60, 60, 900), (0, 30, 10), (500, 20, 60)])
def test_within_time(spark, before, after, chunk):
    r = random.Random(before)
    rows = [(i, r.choice("ab"), r.randrange(3000), r.randrange(9)) for i in range(400)]
    table = spark.createDataFrame(rows, "id long, k string, s long, v long").withColumn("time", F.timestamp_seconds("s"))
    got = within_time(table, ["k"], "time", before, after, {"total": F.sum("v"), "n": F.count(F.lit(1))}, chunk).collect()
    assert len(got) == len(rows)
    for row in got:
        near = [v for _, k, s, v in rows if k == row["k"] and row["s"] - before <= s <= row["s"] + after]
        assert (row["total"], row["n"]) == (sum(near), len(near))


def test_within_time_without_time(spark):
    table = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", 5, 3)], "k string, s long, v long").withColumn("time", F.timestamp_seconds("s"))
    got = within_time(table, ["k"], "time", 1e6, 1e6, {"total": F.sum("v")}).collect()
    assert sorted((x["s"] or 0, x["total"]) for x in got) == [(0, 3), (0, 3), (5, 3)]
