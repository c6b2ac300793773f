"""Tests and tails against textbook values and direct computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackflow.functions.tails import chi2_tail, f_tail, t_two_sided
from trackflow.operators import stats


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def test_tails(spark):
    assert one(spark, chi2_tail(F.lit(3.841458820694124), F.lit(1))) == pytest.approx(0.05, abs=1e-10)
    assert one(spark, chi2_tail(F.lit(24.99579013972863), F.lit(15))) == pytest.approx(0.05, abs=1e-10)
    assert one(spark, chi2_tail(F.lit(866.8), F.lit(15))) < 1e-150
    assert one(spark, t_two_sided(F.lit(2.2281388519649385), F.lit(10))) == pytest.approx(0.05, abs=1e-10)
    assert one(spark, t_two_sided(F.lit(0.0), F.lit(10))) == pytest.approx(1.0)
    assert one(spark, f_tail(F.lit(4.9646027437307145), F.lit(1), F.lit(10))) == pytest.approx(0.05, abs=1e-9)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.choice(list("abcd"), 400, p=[0.55, 0.15, 0.15, 0.15])})
    pdf["v"] = np.round(rng.normal(0, 3, 400) + pdf["g"].map({"a": 0, "b": 0.2, "c": 4, "d": 8}))
    return pdf, spark.createDataFrame(pdf)


def test_kruskal_wallis(sample):
    pdf, df = sample
    got = stats.epsilon_squared(stats.kruskal_wallis(df, "v", "g")).head()
    rank, n = pdf["v"].rank(), len(pdf)
    sums = rank.groupby(pdf["g"]).agg(["sum", "size"])
    ties = pdf["v"].value_counts()
    h = (12 / (n * (n + 1)) * (sums["sum"] ** 2 / sums["size"]).sum() - 3 * (n + 1)) / (1 - (ties**3 - ties).sum() / (n**3 - n))
    assert got["h"] == pytest.approx(h) and (got["n"], got["k"], got["df"]) == (400, 4, 3)
    assert got["effect_size"] == pytest.approx((h - 4 + 1) / (400 - 4))
    assert got["p"] < 1e-6


def test_posthoc_and_letters(sample):
    pdf, df = sample
    got = stats.posthoc(df, "v", "g").toPandas().set_index(["a", "b"]).sort_index()
    rank, n, k = pdf["v"].rank(), len(pdf), 4
    per = rank.groupby(pdf["g"]).agg(["mean", "size"])
    s2 = (np.sum(rank**2) - n * (n + 1) ** 2 / 4) / (n - 1)
    h = ((per["mean"] * per["size"]) ** 2 / per["size"]).sum() - n * (n + 1) ** 2 / 4
    mse = s2 * (n - 1 - h / s2) / (n - k)
    for (a, b), row in got.iterrows():
        t = (per["mean"][a] - per["mean"][b]) / np.sqrt(mse * (1 / per["size"][a] + 1 / per["size"][b]))
        assert row["t"] == pytest.approx(t)
    p = got["p"].to_numpy()
    order = np.argsort(p)
    adjusted = np.empty(6)
    adjusted[order] = np.minimum.accumulate((p[order] * 6 / np.arange(1, 7))[::-1])[::-1]
    np.testing.assert_allclose(got["p_adj"], np.minimum(adjusted, 1))
    assert (got["p_adj"] >= got["p"]).all()
    assert got.loc[("a", "b"), "p_adj"] > 0.05 and got.loc[("c", "d"), "p_adj"] < 0.01


def letters(spark, means, apart):
    groups = spark.createDataFrame([(g, float(m)) for g, m in means.items()], "group string, mean_rank double")
    names = sorted(means)
    rows = [(a, b, (a + b in apart) or (b + a in apart)) for i, a in enumerate(names) for b in names[i + 1 :]]
    pairs = spark.createDataFrame(rows, "a string, b string, differs boolean")
    return {r["group"]: r["letters"] for r in stats.letter_groups(groups, pairs).collect()}


def test_letter_groups(spark):
    means = {"p": 10, "q": 9, "r": 8, "s": 7}
    assert letters(spark, means, set()) == {"p": "a", "q": "a", "r": "a", "s": "a"}
    assert letters(spark, means, {"pr", "ps", "qs"}) == {"p": "a", "q": "ab", "r": "bc", "s": "c"}
    assert letters(spark, means, {"pq", "pr", "ps", "qr", "qs", "rs"}) == {"p": "a", "q": "b", "r": "c", "s": "d"}


def test_levene_and_boxes(sample):
    pdf, df = sample
    z = (pdf["v"] - pdf.groupby("g")["v"].transform("median")).abs()
    per = z.groupby(pdf["g"]).agg(["mean", "size"])
    between = (per["size"] * (per["mean"] - z.mean()) ** 2).sum() / 3
    within = ((z - z.groupby(pdf["g"]).transform("mean")) ** 2).sum() / (400 - 4)
    assert stats.levene(df, "v", "g").head()["f"] == pytest.approx(between / within)
    for r in stats.box_summary(df, "v", ["g"]).collect():
        v = pdf.loc[pdf["g"] == r["g"], "v"]
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (r["q1"], r["median"], r["q3"]) == (q1, v.median(), q3)
        assert (r["whisker_low"], r["whisker_high"], r["n"]) == (inside.min(), inside.max(), len(v))


def test_letters_when_a_later_member_differs(spark):
    """Only B and C differ: they share no letter, though A, before both, differs from neither."""
    from trackflow.operators.stats import letter_groups

    groups = spark.createDataFrame([("A", 10.0), ("B", 9.95), ("C", 8.1)], "group string, mean_rank double")
    pairs = spark.createDataFrame([("A", "B", False), ("A", "C", False), ("B", "C", True)], "a string, b string, differs boolean")
    letters = {r["group"]: set(r["letters"]) for r in letter_groups(groups, pairs).collect()}
    assert letters["A"] & letters["B"] and not letters["B"] & letters["C"]


def test_tail_probabilities(spark):
    """Closed forms: even and single degrees of freedom, F of 2 and n, t squared as F, and large samples."""
    import math

    from pyspark.sql import functions as F

    from trackflow.functions.tails import chi2_tail, f_tail, log_gamma, t_two_sided

    def all_of(fn, rows):
        names = ["s", "a", "b"][: len(rows[0])]
        table = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names))
        return [r["v"] for r in table.select(fn(*map(F.col, names)).alias("v")).collect()]

    chi = [(s, k) for s in (0, 0.3, 2, 9, 40, 700) for k in (2, 4, 10, 40)]
    want = [math.exp(-s / 2) * sum((s / 2) ** i / math.factorial(i) for i in range(k // 2)) for s, k in chi]
    assert all_of(chi2_tail, chi) == pytest.approx(want, rel=1e-11, abs=1e-300)
    one = [0.01, 0.5, 1, 3, 12, 40]
    assert all_of(chi2_tail, [(s, 1) for s in one]) == pytest.approx([math.erfc(math.sqrt(s / 2)) for s in one], rel=1e-11)
    assert all_of(t_two_sided, [(s, 1) for s in one]) == pytest.approx([1 - 2 * math.atan(s) / math.pi for s in one], rel=1e-11)
    assert all_of(t_two_sided, [(-s, 2) for s in one]) == pytest.approx([1 - s / math.sqrt(2 + s * s) for s in one], rel=1e-9)
    assert all_of(t_two_sided, [(s, 1e7) for s in one[:4]]) == pytest.approx([math.erfc(s / math.sqrt(2)) for s in one[:4]], rel=1e-5)
    fs = [(s, 2, n) for s in one for n in (1, 7, 50, 4000)]
    assert all_of(f_tail, fs) == pytest.approx([(1 + 2 * s / n) ** (-n / 2) for s, _, n in fs], rel=1e-9, abs=1e-300)
    assert all_of(f_tail, [(s * s, 1, 33) for s in one]) == pytest.approx(all_of(t_two_sided, [(s, 33) for s in one]), rel=1e-10)
    assert all_of(f_tail, [(float("inf"), 3, 9), (0, 3, 9)]) == [0.0, 1.0]
    assert all_of(log_gamma, [(x,) for x in (0.5, 1, 2.5, 40, 1e6)]) == pytest.approx([math.lgamma(x) for x in (0.5, 1, 2.5, 40, 1e6)], rel=1e-13, abs=1e-14)
    none = spark.range(1).select(chi2_tail(F.lit(None), F.lit(3)).alias("c"), t_two_sided(F.lit(None), F.lit(3)).alias("t"), f_tail(F.lit(1.0), F.lit(0), F.lit(3)).alias("f"))
    assert tuple(none.head()) == (None, None, None)
