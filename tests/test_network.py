"""Pairs, matrices and the permutation test."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackflow.operators import clusters, movement, network, snapshots, stats

# Published co-occurrence counts of 16 animals within five
# metres, the pairs a < b row by row.
HERD = "HO11 HO12 HO13 HO14 HO15 HW05 HW06 HW07 HW08 HW13 HW14 OB02 OB12 OB13 OB14 OB15".split()
COUNTS = """
43 22 19 23 12 1 3 8 7 5 7 15 15 17 21
9 19 7 3 0 2 7 0 0 6 7 24 10 20
15 32 8 6 6 8 7 15 6 15 3 13 14
20 14 1 7 5 2 5 11 21 14 16 17
17 1 7 10 3 11 12 18 10 11 10
12 11 5 8 17 13 8 14 12 19
8 4 10 6 0 2 1 1 2
7 5 10 4 8 7 4 2
7 2 1 7 11 4 5
17 9 12 3 9 8
12 8 9 9 6
8 9 9 14
10 17 14
14 11
21
"""


@pytest.fixture(scope="module")
def published(spark):
    rows = [[int(v) for v in line.split()] for line in COUNTS.strip().splitlines()]
    pairs = [(HERD[i], HERD[i + 1 + j], n) for i, row in enumerate(rows) for j, n in enumerate(row)]
    return spark.createDataFrame(pairs, "a string, b string, n long")


@pytest.fixture(scope="module")
def animals(spark):
    return spark.createDataFrame([(a,) for a in HERD], "animal_id string")


def test_published_matrix_figures(published):
    pairs = network.same_breed(published)
    whole = pairs.agg(F.sum("n"), F.max("n"), F.count(F.when(F.col("n") == 0, 1)), F.corr("n", "same_breed")).head()
    assert tuple(whole)[:3] == (1189, 43, 4)
    assert whole[3] == pytest.approx(0.316516, abs=1e-6)
    box = {r["pair_type"]: r for r in stats.box_summary(pairs, "n", ["pair_type"]).collect()}
    same, mixed = box["same breed"], box["different breed"]
    assert (same["n"], mixed["n"], same["median"], mixed["median"]) == (35, 85, 11, 8)
    assert same["mean"] == pytest.approx(13.2857, abs=1e-4) and mixed["mean"] == pytest.approx(8.5176, abs=1e-4)


def test_mantel_of_labels(spark, published):
    """The same as with all pairs and permutations as rows, on the published counts, random ones, and without spread."""
    import random

    from trackflow.functions.columns import breed_from_animal

    def both(pairs, permutations):
        ids = pairs.select(F.col("a").alias("animal_id")).union(pairs.select("b")).distinct()
        labelled = ids.withColumn("label", breed_from_animal(F.col("animal_id")))
        return (
            stats.mantel_of_labels(pairs.filter("n > 0"), labelled, permutations).head(),
            stats.mantel(network.same_breed(pairs), "same_breed", permutations).head(),
        )

    new, old = both(published, 199)
    assert new["r"] == pytest.approx(0.316516, abs=1e-6) and tuple(new) == pytest.approx(tuple(old))
    r = random.Random(4)
    names = [f"{r.choice(['HO', 'HW', 'OB'])}{i:02d}" for i in range(9)]
    rows = [(min(a, b), max(a, b), r.choice([0, 0, 1, 5])) for i, a in enumerate(names) for b in names[i + 1 :]]
    new, old = both(spark.createDataFrame(rows, "a string, b string, n long"), 99)
    assert tuple(new) == pytest.approx(tuple(old))
    flat = spark.createDataFrame([(a, b, 2) for a, b, _ in rows], "a string, b string, n long")
    assert tuple(stats.mantel_of_labels(flat, spark.createDataFrame([(n, n[:2]) for n in names], "animal_id string, label string"), 9).head()) == (None, None, 9)


def test_mantel_on_the_published_matrix(published):
    out = stats.mantel(network.same_breed(published), "same_breed").head()
    assert out["r"] == pytest.approx(0.316516, abs=1e-6)
    assert 0.001 <= out["p"] <= 0.02
    assert out["permutations"] == 999


def test_matrix_and_back(published, animals):
    matrix = network.pair_matrix(published.filter("n > 0"), animals)
    assert matrix.columns == ["animal_id", *HERD]
    wide = matrix.toPandas().set_index("animal_id").loc[HERD, HERD].to_numpy()
    assert (wide == wide.T).all() and (np.diag(wide) == 0).all()
    back = {(r["a"], r["b"]): r["n"] for r in network.matrix_to_pairs(matrix).collect()}
    assert back == {(r["a"], r["b"]): r["n"] for r in published.collect()}
    zeros = network.with_zero_pairs(published.filter("n > 0"), animals)
    assert {(r["a"], r["b"]): r["n"] for r in zeros.collect()} == back


def test_edges(published):
    edges = network.edge_list(published, 8.0)
    assert edges.count() == 116
    assert edges.agg(F.max("width")).head()[0] == 8.0


@pytest.mark.parametrize("blocks", [1, 3, 8])
def test_all_pairs(animals, blocks):
    got = sorted((r["a"], r["b"]) for r in network.all_pairs(animals, blocks).collect())
    assert got == sorted(itertools.combinations(HERD, 2))


@pytest.fixture(scope="module")
def positions(spark):
    rng = np.random.default_rng(11)
    rows = []
    for gate, n in ((0, 120), (1, 9), (2, 1)):
        for i, (x, y) in enumerate(np.round(rng.uniform(0, 40, (n, 2)) * 2) / 2):
            rows.append(("s", "out", gate, f"HO{i:03d}", 2780000 + float(x), 1161000 + float(y)))
    rows += [("s", "out", 3, "HO001", 2780000.0, 1161000.0), ("s", "out", 3, "HO002", 2780005.0, 1161000.0), ("s", "out", 3, "HO003", None, None)]
    return spark.createDataFrame(rows, "session_id string, direction string, gate_no int, animal_id string, px double, py double")


@pytest.mark.parametrize("hot", [10**6, 5])
@pytest.mark.parametrize("metres", [0.0, 5.0, 12.5])
def test_near_pairs_against_brute_force(positions, monkeypatch, hot, metres):
    monkeypatch.setattr(network, "HOT_GROUP", hot)
    pos = positions.toPandas().dropna()
    want = []
    for gate, group in pos.groupby("gate_no"):
        for p, q in itertools.combinations(group.sort_values("animal_id").itertuples(), 2):
            if np.hypot(p.px - q.px, p.py - q.py) <= metres:
                want.append((gate, p.animal_id, q.animal_id))
    got = [(r["gate_no"], r["a"], r["b"]) for r in network.near_pairs(positions, metres).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("hot", [10**6, 4])
def test_co_cluster_counts(positions, monkeypatch, hot):
    monkeypatch.setattr(network, "HOT_GROUP", hot)
    labels = positions.withColumn("cluster", F.pmod(F.xxhash64("animal_id"), F.lit(3)))
    pdf = labels.toPandas()
    want = {}
    for _, group in pdf.groupby(["gate_no", "cluster"]):
        for pair in itertools.combinations(sorted(group["animal_id"]), 2):
            want[pair] = want.get(pair, 0) + 1
    assert {(r["a"], r["b"]): r["n"] for r in network.co_cluster_counts(labels).collect()} == want


def test_more_metres_never_mean_fewer_meetings(positions):
    few = {(r["a"], r["b"]): r["n"] for r in network.proximity_counts(positions, 3).collect()}
    many = {(r["a"], r["b"]): r["n"] for r in network.proximity_counts(positions, 6).collect()}
    assert all(many.get(k, 0) >= n for k, n in few.items()) and len(many) > len(few)


@pytest.mark.parametrize("block", [256, 16])
def test_mean_pair_distance(positions, block):
    pos = positions.toPandas().dropna()
    got = {r["gate_no"]: r["mean_dist"] for r in movement.mean_pair_distance(positions, block=block).collect()}
    for gate, group in pos.groupby("gate_no"):
        far = [np.hypot(p.px - q.px, p.py - q.py) for p, q in itertools.combinations(group.itertuples(), 2)]
        assert got[gate] == (pytest.approx(np.mean(far)) if far else None)


@pytest.mark.parametrize("hot", [1000, 20])
def test_hull_area(positions, monkeypatch, hot):
    monkeypatch.setattr(movement, "HULL_PART", hot)
    pos = positions.toPandas().dropna()

    def brute(pts):
        # An edge of the hull has all points on one side.
        pts = np.unique(pts, axis=0)
        total, centre = 0.0, pts.mean(axis=0)
        for p, q in itertools.permutations(pts, 2):
            side = (q[0] - p[0]) * (pts[:, 1] - p[1]) - (q[1] - p[1]) * (pts[:, 0] - p[0])
            along = (pts - p) @ (q - p)
            ends = along[side == 0]
            if (side >= 0).all() and ends.min() == 0 and ends.max() == (q - p) @ (q - p):
                total += abs((p[0] - centre[0]) * (q[1] - centre[1]) - (p[1] - centre[1]) * (q[0] - centre[0])) / 2
        return total

    got = {r["gate_no"]: r["area"] for r in movement.hull_area(positions).collect()}
    for gate, group in pos.groupby("gate_no"):
        if len(group) > 2:
            assert got[gate] == pytest.approx(brute(group[["px", "py"]].to_numpy() - [2780000, 1161000]), abs=1e-6)
        else:
            assert got[gate] == 0


def test_clusters_find_clear_blobs(spark):
    rng = np.random.default_rng(2)
    rows, truth = [], {}
    for gate, centres in ((0, [(0, 0), (100, 0)]), (1, [(0, 0), (100, 0), (50, 90)]), (2, [(0, 0)])):
        for i, (cx, cy) in enumerate(centres):
            for j in range(12 if gate < 2 else 2):
                name = f"HO{i}{j:02d}"
                rows.append(("s", "out", gate, name, cx + float(rng.uniform(-3, 3)), cy + float(rng.uniform(-3, 3))))
                truth[(gate, name)] = i
    pos = spark.createDataFrame(rows, "session_id string, direction string, gate_no int, animal_id string, px double, py double")
    got = clusters.snapshot_clusters(pos).toPandas()
    assert set(got["gate_no"]) == {0, 1}
    assert got.groupby("gate_no")["k"].first().to_dict() == {0: 2, 1: 3}
    for gate, group in got.groupby("gate_no"):
        seen = {(truth[(gate, r.animal_id)], r.cluster) for r in group.itertuples()}
        assert len(seen) == len({t for t, _ in seen}) == len({c for _, c in seen})


def test_clusters_repeat_and_are_numbered_by_place(spark, positions):
    some = positions.filter("gate_no < 2")
    key = ["gate_no", "animal_id"]
    one, two = (clusters.snapshot_clusters(df, restarts=4).toPandas().sort_values(key) for df in (some, some.repartition(7, "px")))
    assert one[[*key, "k", "cluster"]].values.tolist() == two[[*key, "k", "cluster"]].values.tolist()
    for _, group in one.groupby("gate_no"):
        assert group.groupby("cluster")["px"].mean().round(6).is_monotonic_increasing
    same = spark.createDataFrame([("s", "out", 1, f"HO{i}", 5.0, 5.0) for i in range(5)], some.select("session_id", "direction", "gate_no", "animal_id", "px", "py").schema)
    assert {(r["k"], r["cluster"]) for r in clusters.snapshot_clusters(same, restarts=2).collect()} == {(2, 1)}


def test_clusters_of_a_crowded_snapshot_are_stable(positions):
    big = positions.filter("gate_no = 0")
    got = clusters.snapshot_clusters(big, restarts=3).toPandas()
    assert len(got) == 120 and 2 <= got["k"].iloc[0] <= 6
    # Every point is nearest to the mean of its own cluster.
    means = got.groupby("cluster")[["px", "py"]].mean()
    far = np.hypot(got["px"].to_numpy()[:, None] - means["px"].to_numpy(), got["py"].to_numpy()[:, None] - means["py"].to_numpy())
    assert (means.index.to_numpy()[far.argmin(axis=1)] == got["cluster"].to_numpy()).all()


def test_calinski_harabasz(spark):
    pts = [(0, 0.0, 0.0, 1), (0, 2.0, 0.0, 1), (0, 10.0, 0.0, 2), (0, 12.0, 0.0, 2)]
    df = spark.createDataFrame(pts, "g int, px double, py double, cluster int")
    row = snapshots.calinski_harabasz(df, ["g"]).head()
    assert (row["k"], row["n"], row["score"]) == (2, 4, pytest.approx((100 / 1) / (4 / 2)))


def test_hull_shapes(spark):
    """Collinear places, one and two places, repeated ones, and a ring whose places are all corners."""
    import math

    shapes = {
        "one": ([(3, 4)] * 3, 1, 0.0), "two": ([(0, 0), (1, 1), (0, 0)], 2, 0.0), "line": ([(i, 2 * i) for i in range(9)], 2, 0.0),
        "square": ([(i, j) for i in range(5) for j in range(5)], 4, 16.0), "triangle": ([(0, 0), (4, 0), (0, 4), (1, 1), (2, 2)], 3, 8.0),
        "ring": ([(math.cos(i), math.sin(i)) for i in range(40)], 40, None),
    }
    rows = [(n, f"a{i}", float(x), float(y)) for n, (places, _, _) in shapes.items() for i, (x, y) in enumerate(places)] + [("none", "a", None, 1.0)]
    table = spark.createDataFrame(rows, "s string, animal_id string, px double, py double")
    for part in (256, 7):
        movement.HULL_PART, before = part, movement.HULL_PART
        try:
            got = {r["s"]: r for r in movement.hull_area(table, ["s"]).collect()}
        finally:
            movement.HULL_PART = before
        assert got.keys() == shapes.keys()
        for name, (_, corners, area) in shapes.items():
            assert got[name]["corners"] == corners and (area is None or got[name]["area"] == pytest.approx(area))
