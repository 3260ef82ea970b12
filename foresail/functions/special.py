"""Distribution functions, as Columns for tables and as plain functions for kernels."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()


def z_value(level: float) -> float:
    """Half-width of a central interval of the standard normal."""
    return NORMAL.inv_cdf(0.5 + level / 2)


# Coefficients of the double-precision rational approximation of the normal tail by Hart, as given by West (2005).
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_LOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def norm_sf_sql(x: str) -> str:
    """SQL for the upper tail of the standard normal, in words that Spark and other engines share."""
    def poly(c: tuple[float, ...]) -> str:
        out = f"CAST({c[0]!r} AS DOUBLE)"
        for k in c[1:]:
            out = f"({out} * abs({x}) + CAST({k!r} AS DOUBLE))"
        return out

    far = f"abs({x})"
    for k in (0.65, 4, 3, 2, 1):
        far = f"(abs({x}) + CAST({k} AS DOUBLE) / {far})" if k != 0.65 else f"(abs({x}) + CAST(0.65 AS DOUBLE))"
    tail = (
        f"(CASE WHEN abs({x}) > 37 THEN CAST(0 AS DOUBLE) WHEN abs({x}) < CAST(7.07106781186547 AS DOUBLE) THEN exp(-{x} * {x} / 2) * {poly(_TOP)} / {poly(_LOW)} "
        f"ELSE exp(-{x} * {x} / 2) / {far} / CAST(2.506628274631 AS DOUBLE) END)"
    )
    return f"(CASE WHEN {x} > 0 THEN {tail} ELSE 1 - {tail} END)"


def norm_sf(x: Column) -> Column:
    return F.element_at(F.transform(F.array(x.cast("double")), lambda v: _norm_sf(v)), 1)


def _norm_sf(v: Column) -> Column:
    a = F.abs(v)

    def poly(c: tuple[float, ...]) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * a + F.lit(k)
        return out

    near = F.exp(-v * v / 2) * poly(_TOP) / poly(_LOW)
    far = a + 0.65
    for k in (4, 3, 2, 1):
        far = a + F.lit(float(k)) / far
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(F.exp(-v * v / 2) / far / 2.506628274631)
    return F.when(v > 0, tail).otherwise(1 - tail)


def norm_cdf(x: Column) -> Column:
    return norm_sf(-x)


def chi2_sf(x: Column, df: int | Column) -> Column:
    """Upper tail of chi-squared with a df of 1 or any even number (all that the tests here need)."""
    x = x.cast("double")
    if isinstance(df, int) and df == 1:
        return F.when(x <= 0, 1.0).when(x > 0, 2 * norm_sf(F.sqrt(F.greatest(x, F.lit(0.0)))))
    n = (F.lit(df) if isinstance(df, int) else df) / 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * (x / 2) / i
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    terms = F.when(n < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n.cast("int") - 1, F.lit(1))))
    return F.when(x <= 0, 1.0).otherwise(F.exp(-x / 2) * F.aggregate(terms, start, step, lambda a: a["total"]))


def t_cdf(x: Column, df: Column) -> Column:
    """Student's t for a whole df, by the finite series in the angle atan(t / sqrt(df))."""
    x, df = x.cast("double"), df.cast("int")
    theta = F.atan(x / F.sqrt(df.cast("double")))
    c, odd = F.cos(theta), df % 2 == 1
    count = F.when(odd, F.floor((df - 1) / 2)).otherwise(F.floor(df / 2)).cast("int")
    first = F.when(odd, c).otherwise(F.lit(1.0))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(a: Column, i: Column) -> Column:
        ratio = F.when(odd, (2 * i) / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))
        term = a["term"] * ratio * c * c
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    terms = F.when(count < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))))
    series = F.when(count < 1, 0.0).otherwise(F.aggregate(terms, start, step, lambda a: a["total"]))
    inside = F.when(odd, (theta + F.sin(theta) * series) * (2 / math.pi)).otherwise(F.sin(theta) * series)
    return F.when(x == float("inf"), 1.0).when(x == float("-inf"), 0.0).otherwise((1 + inside) / 2)


def binomial_quantile(q: float, n: Column, p: float) -> Column:
    """The least k with P(X <= k) >= q, for X binomial over n (a whole column)."""
    start = F.struct(F.pow(F.lit(1 - p), n.cast("double")).alias("term"), F.lit(0.0).alias("total"), F.lit(-1).alias("k"))

    def step(a: Column, k: Column) -> Column:
        total = a["total"] + a["term"]
        found = F.when(a["k"] >= 0, a["k"]).when(total >= F.lit(q) - 1e-15, k).otherwise(F.lit(-1))
        term = a["term"] * (n - k) / (k + 1) * F.lit(p / (1 - p))
        return F.struct(term.cast("double").alias("term"), total.alias("total"), found.alias("k"))

    return F.aggregate(F.sequence(F.lit(0), n.cast("int")), start, step, lambda a: F.when(a["k"] >= 0, a["k"]).otherwise(n.cast("int")))


def gamma_sf(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)
