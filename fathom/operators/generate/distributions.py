"""Random columns of named distributions.

Families with a closed inverse stay inside codegen. Poisson and binomial search a table of cumulative probabilities around the mean, whose
size grows with the deviation and leaves out less than 1e-30 of the mass. The gamma and zipf families reject candidates drawn from a hash
counter of the row. All are Arrow-batched and depend on the row only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.rng import Rng

#: Deviations from the mean that tables reach.
REACH = 13


def _open(rng: Rng, *path: object) -> Column:
    """A uniform in (0, 1]."""
    return F.lit(1.0) - rng.uniform(*path)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th uniform in (0, 1) of each row's stream."""
    with np.errstate(over="ignore"):
        x = _mix(h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gamma_draws(h: np.ndarray, shape: float, stream: int = 0) -> np.ndarray:
    """Gamma(shape, 1) by Marsaglia and Tsang, one per row hash; rows that reject go on with their own counter."""
    boost = shape < 1
    a = shape + 1 if boost else shape
    d = a - 1 / 3
    c = 1 / math.sqrt(9 * d)
    out, todo, k = np.zeros(len(h)), np.arange(len(h)), stream * 1_000_003
    while len(todo):
        u1, u2, u3 = (_draw(h[todo], k + i) for i in range(3))
        x = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
        v = (1 + c * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = (v > 0) & (np.log(u3) < 0.5 * x * x + d - d * v + d * np.log(np.where(v > 0, v, 1)))
        out[todo[ok]] = d * v[ok]
        todo, k = todo[~ok], k + 3
    return out * _draw(h, stream * 1_000_003 + 999_999) ** (1 / shape) if boost else out


def _rowwise(rng: Rng, path: tuple, make: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> Column:
    @F.pandas_udf(kind)
    def draws(bits: pd.Series) -> pd.Series:
        h = _mix(bits.to_numpy().astype(np.int64).view(np.uint64))
        return pd.Series(list(make(h)) if kind.startswith("array") else make(h))

    return draws(rng.bits(*path, "row"))


def _searched(rng: Rng, path: tuple, cdf: np.ndarray, first: int = 0) -> Column:
    @F.pandas_udf("double")
    def search(u: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(cdf, u.to_numpy(), side="right"), len(cdf) - 1) + float(first))

    return search(rng.uniform(*path))


def _window(mean: float, sd: float, top: float) -> tuple[int, int]:
    return max(0, int(mean - REACH * sd - 40)), int(min(top, mean + REACH * sd + 40))


def _cumulated(first: float, steps: np.ndarray) -> np.ndarray:
    """Cumulative probabilities from the logarithm of the first and of the ratios that follow."""
    p = np.exp(first + np.concatenate(([0.0], np.cumsum(steps))))
    return np.cumsum(p) / p.sum()


def poisson_cdf(rate: float) -> tuple[np.ndarray, int]:
    """The table and the value it begins with."""
    low, high = _window(rate, math.sqrt(rate), math.inf)
    return _cumulated(low * math.log(rate) - rate - math.lgamma(low + 1), math.log(rate) - np.log(np.arange(low + 1, high + 1))), low


def binomial_cdf(n: int, p: float) -> tuple[np.ndarray, int]:
    if p in (0.0, 1.0):
        return np.ones(1), int(n * p)
    low, high = _window(n * p, math.sqrt(n * p * (1 - p)), n)
    k = np.arange(low, high)
    first = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log1p(-p)
    return _cumulated(first, np.log((n - k) / (k + 1.0)) + math.log(p) - math.log1p(-p)), low


def zipf_draws(h: np.ndarray, n: int, s: float) -> np.ndarray:
    """Ranks from 1 to n with weight rank^-s by rejection-inversion (Hörmann and Derflinger): no table, whatever n is."""
    area = (lambda x: np.log(x)) if s == 1 else (lambda x: np.expm1((1 - s) * np.log(x)) / (1 - s))
    back = (lambda y: np.exp(y)) if s == 1 else (lambda y: np.exp(np.log1p(np.maximum(y * (1 - s), -1 + 1e-16)) / (1 - s)))
    low, high = float(area(1.5)) - 1, float(area(n + 0.5))
    sure = 2 - float(back(area(2.5) - 2.0**-s))
    out, todo, k = np.ones(len(h)), np.arange(len(h)), 0
    while len(todo):
        y = high + _draw(h[todo], k) * (low - high)
        x = back(y)
        rank = np.clip(np.floor(x + 0.5), 1, n)
        ok = (rank - x <= sure) | (y >= area(rank + 0.5) - rank**-s)
        out[todo[ok]] = rank[ok]
        todo, k = todo[~ok], k + 1
    return out


def _beta(h: np.ndarray, a: float, b: float) -> np.ndarray:
    x, y = gamma_draws(h, a, 0), gamma_draws(h, b, 1)
    return x / (x + y)


def _student(h: np.ndarray, n: float) -> np.ndarray:
    z = np.sqrt(-2 * np.log(_draw(h, 7_000_001))) * np.cos(2 * np.pi * _draw(h, 7_000_002))
    return z / np.sqrt(2 * gamma_draws(h, n / 2) / n)


def _dirichlet(h: np.ndarray, alpha: list[float]) -> np.ndarray:
    g = np.stack([gamma_draws(h, a, i) for i, a in enumerate(alpha)], axis=1)
    return g / g.sum(axis=1, keepdims=True)


def _multinomial(h: np.ndarray, n: int, weights: list[float]) -> np.ndarray:
    cdf = np.cumsum(weights) / sum(weights)
    out = np.zeros((len(h), len(weights)), dtype=np.int64)
    for k in range(n):
        np.add.at(out, (np.arange(len(h)), np.minimum(np.searchsorted(cdf, _draw(h, k), side="right"), len(cdf) - 1)), 1)
    return out


def _triangular(u: Column, lo: float, hi: float, mode: float) -> Column:
    cut = (mode - lo) / (hi - lo)
    return F.when(u < cut, lo + F.sqrt(u * (hi - lo) * (mode - lo))).otherwise(hi - F.sqrt((1 - u) * (hi - lo) * (hi - mode)))


#: name -> (defaults, is valid, column maker)
FAMILIES: dict[str, tuple[dict, Callable[[dict], bool], Callable[[Rng, tuple, dict], Column]]] = {
    "uniform": ({"min": 0.0, "max": 1.0}, lambda p: p["min"] <= p["max"], lambda r, k, p: F.lit(float(p["min"])) + r.uniform(*k) * float(p["max"] - p["min"])),
    "normal": ({"mean": 0.0, "std_dev": 1.0}, lambda p: p["std_dev"] >= 0, lambda r, k, p: r.normal(*k) * float(p["std_dev"]) + float(p["mean"])),
    "log_normal": ({"mu": 0.0, "sigma": 1.0}, lambda p: p["sigma"] >= 0, lambda r, k, p: F.exp(r.normal(*k) * float(p["sigma"]) + float(p["mu"]))),
    "exponential": ({"lambda": 1.0}, lambda p: p["lambda"] > 0, lambda r, k, p: -F.ln(_open(r, *k)) / float(p["lambda"])),
    "bernoulli": ({"p": 0.5}, lambda p: 0 <= p["p"] <= 1, lambda r, k, p: (r.uniform(*k) < float(p["p"])).cast("double")),
    "geometric": ({"p": 0.5}, lambda p: 0 < p["p"] <= 1, lambda r, k, p: F.floor(F.ln(_open(r, *k)) / math.log1p(-p["p"])).cast("double") if p["p"] < 1 else F.lit(0.0)),
    "pareto": ({"scale": 1.0, "shape": 1.0}, lambda p: p["scale"] > 0 and p["shape"] > 0, lambda r, k, p: float(p["scale"]) / F.pow(_open(r, *k), F.lit(1.0 / p["shape"]))),
    "weibull": ({"scale": 1.0, "shape": 1.0}, lambda p: p["scale"] > 0 and p["shape"] > 0, lambda r, k, p: float(p["scale"]) * F.pow(-F.ln(_open(r, *k)), F.lit(1.0 / p["shape"]))),
    "cauchy": ({"median": 0.0, "scale": 1.0}, lambda p: p["scale"] > 0, lambda r, k, p: float(p["median"]) + float(p["scale"]) * F.tan(math.pi * (r.uniform(*k) - 0.5))),
    "triangular": ({"min": 0.0, "max": 1.0, "mode": 0.5}, lambda p: p["min"] < p["max"] and p["min"] <= p["mode"] <= p["max"], lambda r, k, p: _triangular(r.uniform(*k), float(p["min"]), float(p["max"]), float(p["mode"]))),
    "poisson": ({"lambda": 1.0}, lambda p: 0 < p["lambda"] < 1e12, lambda r, k, p: _searched(r, k, *poisson_cdf(float(p["lambda"])))),
    "binomial": ({"n": 10, "p": 0.5}, lambda p: 0 <= p["p"] <= 1 and 0 < p["n"] < 1e12, lambda r, k, p: _searched(r, k, *binomial_cdf(int(p["n"]), float(p["p"])))),
    "zipf": ({"n": 100, "s": 1.0}, lambda p: p["n"] >= 1 and p["s"] > 0, lambda r, k, p: _rowwise(r, k, lambda h: zipf_draws(h, int(p["n"]), float(p["s"])))),
    "gamma": ({"shape": 1.0, "scale": 1.0}, lambda p: p["shape"] > 0 and p["scale"] > 0, lambda r, k, p: _rowwise(r, k, lambda h: gamma_draws(h, float(p["shape"])) * float(p["scale"]))),
    "beta": ({"alpha": 1.0, "beta": 1.0}, lambda p: p["alpha"] > 0 and p["beta"] > 0, lambda r, k, p: _rowwise(r, k, lambda h: _beta(h, float(p["alpha"]), float(p["beta"])))),
    "chi_squared": ({"k": 1.0}, lambda p: p["k"] > 0, lambda r, k, p: _rowwise(r, k, lambda h: 2 * gamma_draws(h, p["k"] / 2))),
    "student_t": ({"n": 5.0}, lambda p: p["n"] > 0, lambda r, k, p: _rowwise(r, k, lambda h: _student(h, float(p["n"])))),
    "dirichlet": ({"alpha": [1.0, 1.0]}, lambda p: len(p["alpha"]) > 1 and min(p["alpha"]) > 0, lambda r, k, p: _rowwise(r, k, lambda h: _dirichlet(h, p["alpha"]), "array<double>")),
    "multinomial": ({"n": 1, "weights": [1.0, 1.0]}, lambda p: 0 < p["n"] <= 10_000 and min(p["weights"]) >= 0 < sum(p["weights"]), lambda r, k, p: _rowwise(r, k, lambda h: _multinomial(h, int(p["n"]), p["weights"]), "array<bigint>")),
}


def distribution(rng: Rng, name: str, params: dict, *path: object, round_: bool = False) -> Column:
    """A column of a family. Missing parameters take the family's defaults; invalid ones raise."""
    if name not in FAMILIES:
        raise ValueError(f"unknown distribution {name}")
    defaults, valid, make = FAMILIES[name]
    p = defaults | params
    if not valid(p):
        raise ValueError(f"invalid parameters for {name}: {p}")
    c = make(rng, (*path, name), p)
    return F.round(c) if round_ else c
