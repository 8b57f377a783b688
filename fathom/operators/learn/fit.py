"""Distribution fits from sufficient statistics: one pass gives every candidate's likelihood, the least AIC wins.

Families: uniform, normal, log_normal, exponential, pareto, poisson, gamma (the likelihood equation solved to a relative error of 1.5 %), beta (by
moments) and zipf, all from sums. The winner's KS distance comes from a
distributed empirical distribution, with the asymptotic p-value. A column without variance or with fewer than two finite
values has no fit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.relational import prefix_sums

FAMILIES = {"uniform": 2, "normal": 2, "log_normal": 2, "exponential": 1, "pareto": 2, "poisson": 1, "gamma": 2, "beta": 2, "zipf": 2}


def sufficient(df: DataFrame, columns: list[str], groups: list[str] = []) -> DataFrame:  # noqa: B006
    """(*groups, column_name, n, s1, s2, sl, sl2, sr, low, high, whole, lgamma): sums of x, x^2, ln x, (ln x)^2 and ln(1 - x), extremes, whether all
    values are non-negative integers, and the sum of ln x! by Stirling's series."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns]
    long = df.select(*groups, F.explode(F.array(*cells)).alias("c")).select(*groups, "c.*").where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    x, lx = F.col("x"), F.when(F.col("x") > 0, F.ln("x"))
    z = x + 1
    stirling = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
    return long.groupBy(*groups, "column_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.sum(lx).alias("sl"), F.sum(lx * lx).alias("sl2"), F.sum(F.when((x > 0) & (x < 1), F.log1p(-x))).alias("sr"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.bool_and((x >= 0) & (x == F.floor(x))).alias("whole"), F.sum(F.when(x >= 0, F.when(x < 2, 0.0).otherwise(stirling))).alias("lgamma"),
    )


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function of x > 0, to some 1e-10: Stirling's series seven steps further on."""
    product = x
    for i in range(1, 7):
        product = product * (x + i)
    z = x + 7
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - F.ln(product)


def ln_harmonic(n: Column, s: Column) -> Column:
    """ln of the sum of k^-s for k up to n: the first terms one by one, the rest by Euler and Maclaurin."""
    head = F.least(n, F.lit(50.0))
    first = F.aggregate(F.sequence(F.lit(1), head.cast("int")), F.lit(0.0), lambda a, k: a + F.pow(k.cast("double"), -s))
    tail = (F.pow(n, 1 - s) - F.pow(head, 1 - s)) / (1 - s) + (F.pow(n, -s) - F.pow(head, -s)) / 2 + s * (F.pow(head, -s - 1) - F.pow(n, -s - 1)) / 12
    return F.ln(first + F.when(n > head, tail).otherwise(0.0))


def likelihoods(stats: DataFrame, keys: list[str] = ["column_name"]) -> DataFrame:  # noqa: B006
    """(*keys, n, family, a, b, log_likelihood, aic, bic) of every family that the values allow."""
    n, mean = F.col("n").cast("double"), F.col("s1") / F.col("n")
    var = F.col("s2") / n - mean * mean
    mu = F.col("sl") / n
    lvar = F.col("sl2") / n - mu * mu
    tail = F.col("sl") - n * F.ln("low")
    two_pi = math.log(2 * math.pi)
    positive = F.col("low") > 0
    # columns of their own, since they stand in many places
    stats = stats.withColumns({"__gap": F.ln(mean) - mu, "__spread": F.try_divide(mean * (1 - mean), var) - 1, "__power": 1 + F.try_divide(n, F.col("sl"))})
    gap, spread, power = F.col("__gap"), F.col("__spread"), F.col("__power")
    stats = stats.withColumns({"__shape": F.try_divide(3 - gap + F.sqrt((gap - 3) * (gap - 3) + 24 * gap), 12 * gap), "__alpha": mean * spread, "__beta": (1 - mean) * spread})
    shape, alpha, beta = F.col("__shape"), F.col("__alpha"), F.col("__beta")
    stats = stats.withColumns({f"__g_{k}": ln_gamma(c) for k, c in (("shape", shape), ("alpha", alpha), ("beta", beta), ("sum", alpha + beta))} | {"__h": F.when((F.col("high") >= 2) & (power > 1) & (power < 10), ln_harmonic(F.col("high"), power))})
    rows = {
        "uniform": (F.lit(True), F.col("low"), F.col("high"), -n * F.ln(F.col("high") - F.col("low"))),
        "normal": (var > 0, mean, F.sqrt(var), -n / 2 * (two_pi + F.ln(var) + 1)),
        "log_normal": (positive & (lvar > 0), mu, F.sqrt(lvar), -F.col("sl") - n / 2 * (two_pi + F.ln(lvar) + 1)),
        "exponential": ((F.col("low") >= 0) & (mean > 0), 1 / mean, F.lit(None).cast("double"), -n * F.ln(mean) - n),
        "pareto": (positive & (tail > 0), F.col("low"), n / tail, n * F.ln(n / tail) + n * n / tail * F.ln("low") - (n / tail + 1) * F.col("sl")),
        "gamma": (positive & (gap > 0), shape, mean / shape, (shape - 1) * F.col("sl") - n * shape - n * shape * F.ln(mean / shape) - n * F.col("__g_shape")),
        "beta": (positive & (F.col("high") < 1) & (var > 0) & (spread > 0), alpha, beta, (alpha - 1) * F.col("sl") + (beta - 1) * F.col("sr") - n * (F.col("__g_alpha") + F.col("__g_beta") - F.col("__g_sum"))),
        "zipf": (F.col("whole") & (F.col("low") >= 1) & (F.col("high") >= 2) & (F.col("sl") > 0) & (power > 1) & (power < 10), F.col("high"), power, -power * F.col("sl") - n * F.col("__h")),
        "poisson": (F.col("whole") & (mean > 0), mean, F.lit(None).cast("double"), F.col("s1") * F.ln(mean) - n * mean - F.col("lgamma")),
    }
    cells = [F.when(ok, F.struct(F.lit(f).alias("family"), a.alias("a"), b.alias("b"), ll.alias("log_likelihood"), (2 * FAMILIES[f] - 2 * ll).alias("aic"), (FAMILIES[f] * F.ln(n) - 2 * ll).alias("bic"))) for f, (ok, a, b, ll) in rows.items()]
    usable = stats.where((F.col("n") >= 2) & (F.col("high") > F.col("low")))
    return usable.select(*keys, "n", F.explode(F.array_compact(F.array(*cells))).alias("x")).select(*keys, "n", "x.*")


def best(stats: DataFrame, keys: list[str] = ["column_name"]) -> DataFrame:  # noqa: B006
    """The family with the least AIC of each key; ties by name."""
    return likelihoods(stats, keys).groupBy(*keys).agg(F.min(F.struct("aic", "family", "a", "b", "n", "bic", "log_likelihood")).alias("x")).select(*keys, "x.family", "x.a", "x.b", "x.n", "x.aic", "x.bic")


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(z) / math.sqrt(2))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-z * z / 2) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def cdf(family: Column, x: Column, a: Column, b: Column) -> Column:
    return (
        F.when(family == "uniform", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a))))
        .when(family == "normal", normal_cdf((x - a) / b))
        .when(family == "log_normal", F.when(x > 0, normal_cdf((F.ln(x) - a) / b)).otherwise(0.0))
        .when(family == "exponential", F.when(x > 0, 1 - F.exp(-a * x)).otherwise(0.0))
        .when(family == "pareto", F.when(x >= a, 1 - F.pow(a / x, b)).otherwise(0.0))
        .when(family.isin("gamma", "beta"), F.pandas_udf(_incomplete, "double")(family, x, a, b))
    )


def _incomplete(family: pd.Series, x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Distribution functions of gamma (shape a, scale b) and beta (a, b); null for other families."""
    out = np.full(len(x), np.nan)
    for name, f in (("gamma", gamma_cdf), ("beta", beta_cdf)):
        mine = (family == name).to_numpy()
        if mine.any():
            out[mine] = f(x.to_numpy(float)[mine], a.to_numpy(float)[mine], b.to_numpy(float)[mine])
    return pd.Series(out)


def gamma_cdf(x: np.ndarray, shape: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: the power series below shape + 1, the continued fraction of the rest above."""
    z = np.maximum(x / scale, 1e-300)
    front = np.exp(shape * np.log(z) - z - np.vectorize(math.lgamma)(shape))
    term, total = 1 / shape, 1 / shape
    for k in range(1, 1000):
        term = term * z / (shape + k)
        total = total + term
    b = z + 1 - shape
    c, d = np.full(len(z), 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d
    for k in range(1, 500):
        an = -k * (k - shape)
        b = b + 2
        d = 1 / np.where(an * d + b == 0, 1e-300, an * d + b)
        c = np.where(b + an / c == 0, 1e-300, b + an / c)
        h = h * d * c
    return np.where(x <= 0, 0.0, np.clip(np.where(z < shape + 1, front * total, 1 - front * h), 0, 1))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction."""
    y = np.clip(x, 1e-300, 1 - 1e-16)
    swap = y > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - y, y)
    lg = np.vectorize(math.lgamma)
    front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(t) + q * np.log1p(-t)) / p
    tiny = 1e-300
    c, d = np.ones(len(t)), 1 - (p + q) * t / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 500):
        for an in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + an * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    v = front * h
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(np.where(swap, 1 - v, v), 0, 1)))


def ks_p_value(d: Column, n: Column) -> Column:
    lam = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * d
    total = F.lit(0.0)
    for k in range(1, 101):
        total = total + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(lam < 0.2, 1.0).otherwise(total)))


def goodness(df: DataFrame, columns: list[str]) -> DataFrame:
    """best() with the KS distance and p-value of continuous winners."""
    chosen = best(sufficient(df, columns))  # one row per column
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("x is not null and not isnan(x)")
    counts = long.groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("k"))
    upto = prefix_sums(counts, ["x"], F.col("k"), ["column_name"]).join(F.broadcast(chosen), "column_name")
    f = cdf(F.col("family"), F.col("x"), F.col("a"), F.col("b"))
    gap = F.greatest(F.abs(F.col("upto") / F.col("n") - f), F.abs((F.col("upto") - F.col("k")) / F.col("n") - f))
    d = upto.groupBy("column_name").agg(F.max(gap).alias("ks"))
    return chosen.join(d, "column_name", "left").withColumn("p_value", ks_p_value(F.col("ks"), F.col("n").cast("double")))
