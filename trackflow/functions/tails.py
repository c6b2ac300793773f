"""Upper tail probabilities of chi-square, Student t and F as column expressions.

Series and continued fractions are folds over as many steps as their convergence needs: about the square root of the
degrees of freedom. A fold that has converged only hands its value on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients of the gamma function for g = 7.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
LEAST_STEPS, STEPS_PER_ROOT, MOST_STEPS = 80, 12, 500_000
TINY, CLOSE = 1e-300, 1e-15


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        total = total + F.lit(c) / (x + i)
    t = x - 1 + (LANCZOS_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(t) - t + F.log(total)


def _steps(size: Column) -> Column:
    """Step numbers 1, 2, ..., enough for parameters of this size."""
    n = F.least(F.lit(MOST_STEPS), F.lit(LEAST_STEPS) + F.ceil(STEPS_PER_ROOT * F.sqrt(size)))
    return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: i.cast("double"))


def _not_zero(v: Column) -> Column:
    return F.when(v == 0, F.lit(TINY)).otherwise(v)


def _fraction(b0: Column, start_c: Column, factor, numbers: Column) -> Column:
    """A continued fraction by the modified Lentz rule; ``factor`` gives the pair (a, b) of a step."""
    first = 1 / _not_zero(b0)
    start = F.struct(start_c.alias("c"), first.alias("d"), first.alias("h"), F.lit(False).alias("done"))

    def step(state: Column, i: Column) -> Column:
        a, b = factor(i)
        d = 1 / _not_zero(a * state["d"] + b)
        c = _not_zero(b + a / state["c"])
        grown = F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"), (F.abs(d * c - 1) < CLOSE).alias("done"))
        return F.when(state["done"], state).otherwise(grown)

    return F.aggregate(numbers, start, step, lambda state: state["h"])


def gamma_upper(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x)."""
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    numbers = _steps(F.greatest(a, x))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

    def longer(state: Column, i: Column) -> Column:
        term = state["term"] * (x / (a + i))
        grown = F.struct(term.alias("term"), (state["total"] + term).alias("total"))
        return F.when(state["term"] < state["total"] * 1e-17, state).otherwise(grown)

    series = F.aggregate(numbers, start, longer, lambda state: state["total"])
    fraction = _fraction(x + 1 - a, F.lit(1 / TINY), lambda i: (-i * (i - a), x + 1 - a + 2 * i), numbers)
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), 1 - front * series)).otherwise(front * fraction)


def beta_lower(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b); ``rest`` is 1 - x."""
    swap = x > (a + 1) / (a + b + 2)
    p, q = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    y, z = F.when(swap, rest).otherwise(x), F.when(swap, x).otherwise(rest)

    def factor(i: Column) -> tuple[Column, Column]:
        m = F.floor((i + 1) / 2).cast("double")
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        return F.when(i % 2 == 1, even).otherwise(odd), F.lit(1.0)

    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log(z)) / p
    found = front * _fraction(1 - (p + q) * y / (p + 1), F.lit(1.0), factor, _steps(F.greatest(a, b)))
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(F.when(swap, 1 - found).otherwise(found))


def chi2_tail(stat: Column, df: Column) -> Column:
    s, k = stat.cast("double"), df.cast("double")
    return F.when(k > 0, gamma_upper(k / 2, s / 2))


def t_two_sided(stat: Column, df: Column) -> Column:
    t2, k = stat.cast("double") * stat.cast("double"), df.cast("double")
    return F.when((k > 0) & stat.isNotNull(), beta_lower(k / 2, F.lit(0.5), k / (k + t2), t2 / (k + t2)))


def f_tail(stat: Column, df1: Column, df2: Column) -> Column:
    f, a, b = stat.cast("double"), df1.cast("double"), df2.cast("double")
    part = F.when(f < float("inf"), a * f / (b + a * f)).otherwise(F.lit(1.0))
    return F.when((a > 0) & (b > 0) & f.isNotNull(), F.when(f > 0, beta_lower(b / 2, a / 2, b / (b + a * f), part)).otherwise(1.0))
