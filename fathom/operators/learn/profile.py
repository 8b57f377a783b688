"""Column profiles: numbers, texts, times, types and categories, each in one aggregation over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.relational import exact_percentiles

PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99]

#: Patterns that texts are tested for.
PATTERNS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "phone": r"^\+?[0-9][0-9 ().-]{6,18}[0-9]$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "url": r"^https?://[^\s/]+(/[^\s]*)?$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "name": r"^[A-Z][a-z]+( [A-Z][a-z]+)+$",
    "hex": r"^[0-9a-f]{8,}$",
}


def _stacked(df: DataFrame, columns: list[str], measures: dict[str, callable]) -> DataFrame:
    """One row per column from one wide aggregation: each measure maps a column to an aggregate."""
    aggs = [m(F.col(f"`{c}`")).alias(f"{i}_{n}") for i, c in enumerate(columns) for n, m in measures.items()]
    cells = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{i}_{n}`").alias(n) for n in measures]) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def column_counts(df: DataFrame, columns: list[str], distinct_cap: int | None = None) -> DataFrame:
    """(column_name, rows, nulls, null_rate, empty_rate, distinct, cardinality_ratio); the distinct count is cut off at the cap if one is given."""
    out = _stacked(
        df,
        columns,
        {
            "rows": lambda c: F.count(F.lit(1)),
            "nulls": lambda c: F.count(F.when(c.isNull(), 1)),
            "empties": lambda c: F.count(F.when(c.cast("string") == "", 1)),
            "distinct": lambda c: F.count_distinct(c),
        },
    )
    distinct = F.least("distinct", F.lit(distinct_cap)) if distinct_cap else F.col("distinct")
    full = F.col("rows") - F.col("nulls")
    return out.select("column_name", "rows", "nulls", F.try_divide("nulls", "rows").alias("null_rate"), F.try_divide("empties", "rows").alias("empty_rate"), distinct.alias("distinct"), F.try_divide(distinct, full).alias("cardinality_ratio"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, min, max, mean, std, skewness, kurtosis): sample standard deviation, bias-adjusted skewness and excess
    kurtosis. Skewness needs three values, kurtosis four, both some variance."""
    x = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    out = _stacked(df, columns, {"n": lambda c: F.count(x(c)), "min": lambda c: F.min(x(c)), "max": lambda c: F.max(x(c)), "mean": lambda c: F.avg(x(c)), "std": lambda c: F.stddev_samp(x(c)), "g1": lambda c: F.skewness(x(c)), "g2": lambda c: F.kurtosis(x(c))})
    n = F.col("n").cast("double")
    skew = F.when((F.col("n") > 2) & (F.col("std") > 0), F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((F.col("n") > 3) & (F.col("std") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return out.select("column_name", "n", "min", "max", "mean", "std", skew.alias("skewness"), kurt.alias("kurtosis"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """moments with percentiles p1 to p99."""
    return moments(df, columns).join(exact_percentiles(df, columns, PERCENTILES), "column_name", "left")


def decimal_places(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, places, n): how many values show how many decimal places, from the shortest text of a double."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").cast("string").alias("t")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("t is not null and not contains(t, 'E')")
    fraction = F.regexp_replace(F.element_at(F.split("t", r"\."), 2), "0+$", "")
    return long.groupBy("column_name", F.char_length(fraction).alias("places")).agg(F.count(F.lit(1)).alias("n"))


def text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, min_length, max_length, avg_length, and the share of non-null values per pattern)."""
    rate = lambda p: lambda c: F.avg(c.rlike(p).cast("double"))
    return _stacked(df, columns, {"min_length": lambda c: F.min(F.char_length(c)), "max_length": lambda c: F.max(F.char_length(c)), "avg_length": lambda c: F.avg(F.char_length(c)), **{f"{k}_rate": rate(p) for k, p in PATTERNS.items()}})


def temporal_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, first, last, granularity): granularity follows from the span between first and last."""
    out = _stacked(df, columns, {"first": lambda c: F.min(F.unix_millis(c.cast("timestamp"))), "last": lambda c: F.max(F.unix_millis(c.cast("timestamp")))})
    span = (F.col("last") - F.col("first")) / 1000.0
    grain = F.when(span < 1, "sub-second").when(span < 60, "second").when(span < 3600, "minute").when(span < 86400, "hour").otherwise("day")
    return out.select("column_name", "first", "last", F.when(span.isNotNull(), grain).alias("granularity"))


def inferred_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, inferred): what text columns hold. Tests in order: patterns, integer, number, boolean, uuid (95 % of values
    each), date (90 %), few values (category), else text. For up to 200 rows half, for up to 50 rows 80 % distinct still count as few."""
    given = lambda c: F.when((c.isNotNull()) & (c.cast("string") != ""), c.cast("string"))
    on = lambda test: lambda c: F.avg(test(F.trim(given(c))).cast("double"))
    out = _stacked(
        df,
        columns,
        {
            "n": lambda c: F.count(given(c)),
            "distinct": lambda c: F.count_distinct(given(c)),
            **{k: on(lambda t, p=p: t.rlike(p)) for k, p in PATTERNS.items() if k in ("email", "url", "uuid", "date")},
            "integer": on(lambda t: t.rlike(r"^[+-]?[0-9]+$")),
            "float": on(lambda t: t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")),
            "bool": on(lambda t: F.lower(t).isin("true", "false", "yes", "no", "t", "f", "y", "n")),
        },
    )
    few = F.when(F.col("n") <= 50, 0.8).when(F.col("n") <= 200, 0.5).otherwise(0.05)
    kind = F.when(F.col("n") == 0, "text")
    for name, least in (("email", 0.95), ("url", 0.95), ("integer", 0.95), ("float", 0.95), ("bool", 0.95), ("uuid", 0.95), ("date", 0.90)):
        kind = kind.when(F.col(name) >= least, name)
    return out.select("column_name", kind.when(F.col("distinct") <= few * F.col("n"), "category").otherwise("text").alias("inferred"))


def category_shares(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, n, share) of non-null values, most frequent first; ties by value."""
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(f"`{column}`").alias("total"))  # one row
    out = counts.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))
    return out.orderBy(F.desc("n"), "value").limit(limit) if limit else out


def traits(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, cardinality, shape) of numeric columns: unique, high, medium or low cardinality by the ratio of distinct values
    (.99, .30, .01), and skewed, heavy-tailed, flat or bell-shaped by moments and percentiles."""
    p = numeric_profile(df, columns).join(column_counts(df, columns, None).select("column_name", "cardinality_ratio"), "column_name")
    ratio: Column = F.col("cardinality_ratio")
    size = F.when(ratio >= 0.99, "unique").when(ratio >= 0.30, "high").when(ratio >= 0.01, "medium").otherwise("low")
    middle = F.try_divide(F.col("p90") - F.col("p10"), F.col("max") - F.col("min"))
    shape = F.when(F.col("skewness") > 0.5, "right_skewed").when(F.col("skewness") < -0.5, "left_skewed").when(F.col("kurtosis") > 3, "heavy_tailed").when((F.col("kurtosis") < -1) & (middle > 0.7), "flat").when(F.abs("kurtosis") <= 1, "bell").otherwise("other")
    return p.select("column_name", size.alias("cardinality"), shape.alias("shape"))
