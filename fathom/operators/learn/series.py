"""Time series structure: order, trend, autocorrelation, seasons, intervals and calendar patterns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.relational import lagged, row_index

CHI_WEEKDAYS, CHI_HOURS = 12.592, 35.172


def sort_order(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """(column_name, pairs, direction): whether a column rises or falls along an order. Ties count as both."""
    now, before = F.col(column), F.col("__before")
    rows = lagged(df.select(*dict.fromkeys([*order, column])), [], order, column, "__before")
    s = rows.where(now.isNotNull() & before.isNotNull()).agg(F.count(F.lit(1)).alias("pairs"), F.bool_and(now >= before).alias("up"), F.bool_and(now <= before).alias("down"))
    direction = F.when(F.col("pairs") < 2, "unknown").when(F.col("up"), "ascending").when(F.col("down"), "descending").otherwise("unsorted")
    return s.select(F.lit(column).alias("column_name"), "pairs", direction.alias("direction"))


def trend(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """(column_name, n, slope, intercept, r2, trending) of a linear fit on the row number; trending from R2 = .3 on."""
    x = row_index(df.select(*dict.fromkeys([*order, column])).where(F.col(column).isNotNull()), order, "__i")
    y = F.col(column).cast("double")
    s = x.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, F.col("__i")).alias("slope"), F.regr_intercept(y, F.col("__i")).alias("intercept"), F.regr_r2(y, F.col("__i")).alias("r2"))
    return s.select(F.lit(column).alias("column_name"), "*", F.coalesce(F.col("r2") >= 0.3, F.lit(False)).alias("trending"))


def trend_noise(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """(column_name, n, noise): the deviation of a series around its trend, from the differences of neighbours, whose variance is twice the noise's."""
    rows = lagged(df.select(*dict.fromkeys([*order, column])).where(F.col(column).isNotNull()), [], order, column, "__before")
    step = F.col(column).cast("double") - F.col("__before").cast("double")
    return rows.agg(F.count(step).alias("n"), (F.stddev_samp(step) / F.sqrt(F.lit(2.0))).alias("noise")).select(F.lit(column).alias("column_name"), "n", "noise")


def autocorrelation(df: DataFrame, order: list[str], column: str, lags: list[int]) -> DataFrame:
    """(lag, n, acf) of a series: sum of (x_i - m)(x_{i+k} - m) over the sum of squares. Lagged pairs come from an equi-join on
    the row number, so a long series is spread over tasks."""
    x = row_index(df.select(*dict.fromkeys([*order, column])).where(F.col(column).isNotNull()), order, "__i")
    m = x.agg(F.avg(column).alias("__m"), F.sum(F.pow(F.col(column).cast("double"), 2)).alias("__q"), F.count(F.lit(1)).alias("__n"))
    v = x.join(F.broadcast(m)).select("__i", (F.col(column) - F.col("__m")).alias("v"), (F.col("__q") - F.col("__n") * F.col("__m") * F.col("__m")).alias("ss"))
    shifted = v.select(F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), "__i", F.col("v").alias("w")).withColumn("__i", F.col("__i") - F.col("lag"))
    pairs = shifted.join(v, "__i")
    return pairs.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col("v") * F.col("w")), F.max("ss")).alias("acf"))


def season_length(values: np.ndarray, most: int | None = None) -> int:
    """The first peak of the autocorrelation of at least .3 after it has fallen below that, at lags 4 to n/3, or ``most`` if given; 0 if none."""
    n = len(values)
    top = min(n // 3, most or n)
    x = values - values.mean()
    total = float((x * x).sum())
    if top < 4 or total <= 0:
        return 0
    spectrum = np.fft.rfft(x, 2 * n)
    acf = np.fft.irfft(spectrum * np.conj(spectrum))[: top + 1] / total
    low = np.flatnonzero(acf < 0.3)
    if not len(low):
        return 0
    for k in range(max(4, int(low[0])), top):
        if acf[k] >= 0.3 and acf[k] >= acf[k - 1] and acf[k] >= acf[k + 1]:
            return k
    return 0


def seasons(df: DataFrame, series: str, time: str, value: str) -> DataFrame:
    """(series, n, period, amplitude) of each series, amplitude half the interquartile range. A series is inherently sequential, so each
    is one group of applyInPandas and different series run in parallel."""
    kind = dict(df.dtypes)[series]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values([time, value])[value].dropna().to_numpy(dtype=float)
        period = season_length(v) if len(v) >= 12 else 0
        spread = float((np.percentile(v, 75) - np.percentile(v, 25)) / 2) if period else None
        return pd.DataFrame({"series": [pdf[series].iloc[0]], "n": [len(v)], "period": [period], "amplitude": [spread]})

    return df.select(series, time, value).groupBy(series).applyInPandas(one, f"series {kind}, n long, period int, amplitude double")


def interval_pattern(df: DataFrame, series: str, time: str) -> DataFrame:
    """(series, n, mean_gap, cv, pattern, confidence): gaps between consecutive times of each series; below a coefficient of variation of
    .05 they are a fixed interval."""
    times = df.where(F.col(time).isNotNull()).select(F.col(series).alias("series"), (F.unix_millis(F.col(time).cast("timestamp")) / 1000.0).alias("at"))
    gaps = lagged(times, ["series"], ["at"], "at", "before").select("series", (F.col("at") - F.col("before")).alias("gap"))
    s = gaps.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("mean_gap"), F.stddev_pop(F.when(F.col("gap") > 0, F.col("gap"))).alias("sd"))
    cv = F.try_divide("sd", "mean_gap")
    fixed = F.col("n") >= 3
    return s.select("series", "n", "mean_gap", cv.alias("cv"), F.when(fixed & (cv < 0.05), "fixed_interval").otherwise("variable").alias("pattern"), F.when(fixed & (cv < 0.05), F.greatest(F.lit(0.5), F.least(F.lit(1.0), 1 - 10 * cv))).alias("confidence"))


def time_pattern(times: np.ndarray) -> tuple[str, float, float]:
    """(pattern, period in seconds, confidence) of sorted times: fixed interval, schedule (near a day, a week or 30 days), periodic, trend or
    irregular."""
    t = np.sort(times[np.isfinite(times)])
    n = len(t)
    gaps = np.diff(t)
    gaps = gaps[gaps > 0]
    if n < 3 or not len(gaps):
        return "irregular", 0.0, 0.0
    mean = float(gaps.mean())
    cv = float(gaps.std() / mean)
    if cv < 0.05:
        return "fixed_interval", mean, float(min(1.0, max(0.5, 1 - 10 * cv)))
    size = 1 << (len(gaps) - 1).bit_length()
    power = np.abs(np.fft.rfft(np.concatenate((gaps - mean, np.zeros(size - len(gaps))))))[1 : size // 2]
    if len(power) and power.max() >= 2 * power.mean() > 0:
        period = size * mean / (int(power.argmax()) + 1)
        for unit in (86_400.0, 604_800.0, 2_592_000.0):
            if abs(period - unit) <= 0.15 * unit:
                return "schedule", unit, 0.7
        return "periodic", float(period), float(min(1.0, power.max() / power.sum() * 2))
    if n >= 10:
        counts, _ = np.histogram(t, bins=min(20, n // 2))
        slope = np.polyfit(np.arange(len(counts)), counts, 1)[0]
        if abs(slope) > 1e-12:
            return "trend", 0.0, 0.5
    return "irregular", 0.0, 0.0


def time_patterns(df: DataFrame, series: str, time: str) -> DataFrame:
    """time_pattern of each series, in parallel over series."""
    kind = dict(df.dtypes)[series]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p, period, c = time_pattern(pdf["t"].dropna().to_numpy(dtype=float))
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "n": [len(pdf)], "pattern": [p], "period": [period], "confidence": [c]})

    src = df.select(F.col(series).alias("series"), (F.unix_millis(F.col(time).cast("timestamp")) / 1000.0).alias("t"))
    return src.groupBy("series").applyInPandas(one, f"series {kind}, n long, pattern string, period double, confidence double")


def calendar_pattern(df: DataFrame, time: str) -> DataFrame:
    """(part, chi2, patterned): chi-squared of counts by weekday and by hour against a uniform spread, at 5 %."""
    t = F.col(time).cast("timestamp")
    one = df.where(t.isNotNull()).agg(*[F.count(F.when(F.weekday(t) == d, 1)).alias(f"d{d}") for d in range(7)], *[F.count(F.when(F.hour(t) == h, 1)).alias(f"h{h}") for h in range(24)], F.count(F.lit(1)).alias("n"))

    def chi(prefix: str, k: int):
        return sum((F.pow(F.col(f"{prefix}{i}") - F.col("n") / k, 2) / (F.col("n") / k) for i in range(k)), F.lit(0.0))

    rows = F.array(*[F.struct(F.lit(p).alias("part"), c.alias("chi2"), (c > limit).alias("patterned")) for p, c, limit in (("weekday", chi("d", 7), CHI_WEEKDAYS), ("hour", chi("h", 24), CHI_HOURS))])
    return one.where("n > 0").select(F.explode(rows).alias("x")).select("x.*")


def calendar_counts(df: DataFrame, time: str) -> DataFrame:
    """(weekday, hour, n) with Monday as 0."""
    t = F.col(time).cast("timestamp")
    return df.where(t.isNotNull()).groupBy(F.weekday(t).cast("long").alias("weekday"), F.hour(t).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def relative_times(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """(earlier, later, n, in_order, mean_gap, std_gap): whether one time always follows another, with the gap in seconds."""
    a, b = (F.unix_millis(F.col(c).cast("timestamp")) / 1000.0 for c in (earlier, later))
    s = df.agg(F.count(b - a).alias("n"), F.avg((b >= a).cast("double")).alias("in_order"), F.avg(b - a).alias("mean_gap"), F.stddev_samp(b - a).alias("std_gap"))
    return s.select(F.lit(earlier).alias("earlier"), F.lit(later).alias("later"), "*")
