"""Time series, event streams and dependent columns.

Components without memory are column expressions; running totals are distributed scans. Recurrences (autoregression, mean reversion, spikes
that decay) are linear, so a series is cut into blocks of ``BLOCK`` steps: each block runs from rest, the states at the ends are carried from block to
block, one row a block, and each block then runs again from its true state. No task holds more than a block, however long a series is.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.rng import Rng
from fathom.operators.generate.distributions import _draw, _mix
from fathom.operators.relational import prefix_sums


BLOCK = 65_536


def trend(step: Column, start: float = 0.0, slope: float = 0.0, curve: float = 0.0) -> Column:
    return F.lit(float(start)) + step * float(slope) + step * step * float(curve)


def seasonality(step: Column, period: float, amplitude: float, phase: float = 0.0) -> Column:
    return F.lit(float(amplitude)) * F.sin(2 * math.pi * (step + float(phase)) / float(period))


def calendar(time: Column, weekend: float = 1.0, business: float = 1.0, hours: tuple[int, int] = (9, 17), holidays: list[str] = (), holiday: float = 1.0) -> Column:
    """A factor: weekends, business hours on working days, and holidays each multiply."""
    t = time.cast("timestamp")
    off = F.weekday(t) >= 5
    f = F.when(off, F.lit(float(weekend))).otherwise(1.0)
    f = f * F.when(~off & (F.hour(t) >= hours[0]) & (F.hour(t) < hours[1]), F.lit(float(business))).otherwise(1.0)
    return f * F.when(F.to_date(t).cast("string").isin(list(holidays)), F.lit(float(holiday))).otherwise(1.0) if holidays else f


def level_shift(df: DataFrame, rng: Rng, series: str, step: str, p: float, size: float, name: str = "level") -> DataFrame:
    """A level that jumps by N(0, size) with probability p at each step: a running total per series."""
    jump = F.when(rng.uniform("jump") < p, rng.normal("size") * size).otherwise(0.0)
    return prefix_sums(df.withColumn("__j", jump), [step], F.col("__j"), [series], name).drop("__j")


def recurrence(df: DataFrame, rng: Rng, series: str, step: str, name: str = "value", ar: list[float] = (), mean: float = 0.0, reversion: float = 0.0, sigma: float = 1.0, spike_p: float = 0.0, spike_size: float = 0.0, spike_decay: float = 0.5, block: int = BLOCK) -> DataFrame:
    """Autoregression around a mean, pulled back by ``reversion``, with spikes that decay. ``step`` numbers the rows of a series from 0 on."""
    order = max(1, len(ar))
    # the state is the last values and the spike; one step multiplies it by this and adds the row's noise and spike
    turn = np.zeros((order + 1, order + 1))
    turn[0, : len(ar)] = ar
    turn[0, 0] -= reversion
    turn[range(1, order), range(order - 1)] = 1.0
    turn[order, order] = spike_decay

    def values(pdf: pd.DataFrame, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(pdf["__h"].to_numpy().astype(np.int64).view(np.uint64))
        z = np.sqrt(-2 * np.log(_draw(h, 0))) * np.cos(2 * np.pi * _draw(h, 1)) * sigma
        hit, out = np.where(_draw(h, 2) < spike_p, spike_size, 0.0), np.zeros(len(pdf))
        for i in range(len(pdf)):
            state = turn @ state
            state[0] += z[i]
            state[order] += hit[i]
            out[i] = mean + state[0] + state[order]
        return out, state

    blocks = df.withColumn("__h", rng.bits("series")).withColumn("__block", F.floor(F.col(step) / block).cast("long"))
    kind = dict(df.dtypes)[series]

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(step)
        _, state = values(pdf, np.zeros(order + 1))
        return pd.DataFrame({series: [pdf[series].iloc[0]], "__block": [pdf["__block"].iloc[0]], "size": [len(pdf)], "state": [state.tolist()]})

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("__block"), np.zeros(order + 1), []
        for size, end in zip(pdf["size"], pdf["state"], strict=True):
            out.append(state.tolist())
            state = np.linalg.matrix_power(turn, int(size)) @ state + np.array(end)
        return pd.DataFrame({series: pdf[series], "__block": pdf["__block"], "__state": out})

    columns = [*df.columns, name]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(step)
        out, _ = values(pdf, np.array(pdf["__state"].iloc[0]))
        return pdf.assign(**{name: out})[columns]

    # one row a block: the groups of this step are as long as a series has blocks
    last = blocks.select(series, step, "__h", "__block").groupBy(series, "__block").applyInPandas(ends, f"`{series}` {kind}, __block long, size long, state array<double>")
    first = last.groupBy(series).applyInPandas(carried, f"`{series}` {kind}, __block long, __state array<double>")
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + f", `{name}` double"
    return blocks.join(first, [series, "__block"]).groupBy(series, "__block").applyInPandas(run, schema)


def event_stream(rows: DataFrame, rng: Rng, series: str, step: str, rate_per_s: float, start: str = "2024-01-01", profile: list[float] | None = None, name: str = "ts") -> DataFrame:
    """Times with exponential gaps per series. With 24 hourly ``profile`` factors the stream runs at the greatest rate and events are kept
    in proportion (thinning), so fewer rows come out."""
    top = max(profile) if profile else 1.0
    gap = -F.ln(F.lit(1.0) - rng.uniform("gap")) / (rate_per_s * top)
    at = prefix_sums(rows.withColumn("__gap", gap), [step], F.col("__gap"), [series], "__s")
    out = at.withColumn(name, F.timestamp_millis(F.unix_millis(F.lit(start).cast("timestamp")) + (F.col("__s") * 1000).cast("long"))).drop("__gap", "__s")
    if profile:
        factor = F.element_at(F.array(*[F.lit(float(p)) for p in profile]), F.hour(name) + 1)
        out = out.where(rng.uniform("keep") < factor / top)
    return out


def bursts(rows: DataFrame, rng: Rng, actor: str, step: str, size: float, gap_s: float, idle_s: float, start: str = "2024-01-01", name: str = "ts") -> DataFrame:
    """Times in bursts per actor: short exponential gaps, and a long one with probability 1/size."""
    mean = F.when(rng.uniform("end") < 1.0 / size, F.lit(float(idle_s))).otherwise(float(gap_s))
    at = prefix_sums(rows.withColumn("__gap", -F.ln(F.lit(1.0) - rng.uniform("gap")) * mean), [step], F.col("__gap"), [actor], "__s")
    return at.withColumn(name, F.timestamp_millis(F.unix_millis(F.lit(start).cast("timestamp")) + (F.col("__s") * 1000).cast("long"))).drop("__gap", "__s")


# --- dependence


def correlated(df: DataFrame, rng: Rng, source: str, r: float, mean: float, std: float, name: str) -> DataFrame:
    """A column with correlation r to ``source``: r*x + sqrt(1-r^2)*z of the standardised source, over the whole table."""
    s = df.agg(F.avg(source).alias("__m"), F.stddev_pop(source).alias("__s"))
    x = F.coalesce(F.try_divide(F.col(source) - F.col("__m"), F.col("__s")), F.lit(0.0))
    return df.join(F.broadcast(s)).withColumn(name, (x * r + rng.normal("z") * math.sqrt(1 - r * r)) * std + mean).drop("__m", "__s")


def clayton(u: Column, t: Column, theta: float) -> Column:
    """The second uniform of a Clayton copula given the first and an independent uniform."""
    return F.pow(F.pow(u, F.lit(-theta)) * (F.pow(t, F.lit(-theta / (1 + theta))) - 1) + 1, F.lit(-1 / theta))


def frank(u: Column, t: Column, theta: float) -> Column:
    e = math.exp(-theta)
    return -F.ln(1 + t * (e - 1) / (t + (1 - t) * F.exp(-theta * u))) / theta


def gumbel(rng: Rng, theta: float, *path: object) -> tuple[Column, Column]:
    """Two uniforms of a Gumbel copula by a positive stable variable (Chambers, Mallows and Stuck)."""
    a = 1 / theta
    v = (rng.uniform(*path, "v") + 2.0**-54) * math.pi
    e = -F.ln(F.lit(1.0) - rng.uniform(*path, "e"))
    s = F.sin(a * v) / F.pow(F.sin(v), F.lit(1 / a)) * F.pow(F.sin((1 - a) * v) / e, F.lit((1 - a) / a)) if theta > 1 else F.lit(1.0)
    pair = [F.exp(-F.pow(-F.ln(F.lit(1.0) - rng.uniform(*path, i)) / s, F.lit(a))) for i in ("x", "y")]
    return pair[0], pair[1]


def cholesky(matrix: list[list[float]]) -> np.ndarray:
    """The lower factor of a correlation matrix; a matrix that is not positive definite is an error."""
    m = np.array(matrix, dtype=float)
    if m.shape[0] != m.shape[1] or not np.allclose(m, m.T) or not np.allclose(np.diag(m), 1):
        raise ValueError("a correlation matrix is square, symmetric and has ones on its diagonal")
    return np.linalg.cholesky(m)


def gaussian_copula(df: DataFrame, rng: Rng, key: str, columns: list[str], matrix: list[list[float]]) -> DataFrame:
    """Columns reordered to a rank correlation (Iman and Conover): every column keeps its values, and takes the order of a correlated normal
    score. Ranks are global and distributed, one range-partitioned pass per column and score."""
    low = cholesky(matrix)
    z = [rng.normal("score", i) for i in range(len(columns))]
    scored = df.select(F.col(key), *columns, *[sum((z[j] * float(low[i, j]) for j in range(i + 1)), F.lit(0.0)).alias(f"__z{i}") for i in range(len(columns))])
    one, out = F.lit(1).cast("long"), df.drop(*columns)
    for i, c in enumerate(columns):
        places = prefix_sums(scored.select(key, f"__z{i}"), [f"__z{i}", key], one, name="__r").select(key, "__r")
        values = prefix_sums(scored.select(F.col(key).alias("__k"), c), [c, "__k"], one, name="__r").select("__r", c)
        out = out.join(places.join(values, "__r").drop("__r"), key)
    return out.select(*df.columns)
