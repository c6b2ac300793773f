"""Chunked windows, ranks and quantiles against plain computations on random data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackflow.operators.ordered import mid_ranks, neighbours, quantiles, running_total


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 600
    # One key holds most rows; positions have gaps, values repeat and some are NULL.
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)),
            "pos": rng.permutation(n * 3)[:n],
            "v": rng.integers(0, 12, n).astype("float64"),
        }
    )
    pdf.loc[pdf.index % 17 == 0, "v"] = np.nan
    rows = [(r.k, int(r.pos), None if np.isnan(r.v) else float(r.v)) for r in pdf.itertuples()]
    return pdf, spark.createDataFrame(rows, "k string, pos long, v double")


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
@pytest.mark.parametrize("offsets", [(1,), (-1,), (1, -1), (2, -2, 1, -1), (3,), (-3, 3)])
def test_neighbours(table, size, offsets):
    pdf, df = table
    wanted = {f"o{i}": ("v", o) for i, o in enumerate(offsets)} | {"p": ("pos", offsets[0])}
    got = neighbours(df, ["k"], ["pos"], wanted, F.floor(F.col("pos") / size)).toPandas().sort_values(["k", "pos"])
    want = pdf.sort_values(["k", "pos"]).reset_index(drop=True)
    assert len(got) == len(want)
    for name, (c, o) in wanted.items():
        expected = want.groupby("k")[c].shift(-o)
        pd.testing.assert_series_equal(got[name].reset_index(drop=True).astype("float64"), expected.astype("float64"), check_names=False)


@pytest.mark.parametrize("size", [1, 50, 10**6])
def test_running_total(table, size):
    pdf, df = table
    value = F.coalesce("v", F.lit(0.0))
    got = running_total(df, ["k"], ["pos"], value, F.floor(F.col("pos") / size), "total").toPandas().sort_values(["k", "pos"])
    want = pdf.fillna({"v": 0}).sort_values(["k", "pos"]).groupby("k")["v"].cumsum()
    assert got["total"].tolist() == want.tolist()


def test_mid_ranks(table):
    pdf, df = table
    got = mid_ranks(df, ["k"], "v", "r").toPandas().sort_values(["k", "pos"])
    want = pdf.sort_values(["k", "pos"]).groupby("k")["v"].rank()
    np.testing.assert_array_equal(got["r"].astype("float64").to_numpy(), want.to_numpy())


def test_quantiles(table):
    pdf, df = table
    got = quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).toPandas().set_index("k").sort_index()
    for name, share in (("a", 0.25), ("b", 0.5), ("c", 0.9)):
        want = pdf.groupby("k")["v"].quantile(share)
        np.testing.assert_allclose(got[name].to_numpy(), want.to_numpy())
    whole = quantiles(df, [], "v", {"m": 0.5}).head()
    assert whole["m"] == pdf["v"].quantile(0.5)


def test_value_ranges_follow_the_rows(spark, monkeypatch):
    """Ranges never fall along the values, and hundred times the rows do not make the largest one larger."""
    from trackflow.operators import ordered
    from trackflow.operators.tables import materialise

    monkeypatch.setattr(ordered, "ROWS_PER_RANGE", 100)
    largest = {}
    for n in (500, 50_000):
        table = materialise(spark.range(n).select((F.col("id") * 37 % n).cast("double").alias("v")))
        found = table.withColumn("c", ordered.value_chunk(table, "v"))
        sizes = found.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("c").collect()
        assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:])) and sum(r["n"] for r in sizes) == n
        largest[n] = max(r["n"] for r in sizes)
    assert max(largest.values()) <= 200
    one = materialise(spark.range(50).select(F.col("id").cast("double").alias("v")))
    assert one.select(ordered.value_chunk(one, "v").alias("c")).distinct().count() == 1
