"""Percentiles of very large numeric columns: counts in signed logarithmic buckets of fixed relative width.

Every value becomes a bucket key by a JVM expression (fathom.functions.buckets); a partial result is the count per
group and key, combined map-side, and partial results of tasks, loads or days are combined by adding counts. A percentile is the
centre of the bucket that holds its nearest rank, so it lies within the stated relative error of the exact
percentile of that rank, whatever the distribution. A group holds at most a few thousand keys for any number of rows; coarser
groups are made from the finer ones' counts.

Percentile p of n values is that of rank round(p/100 * (n-1)), counted from 0 in ascending order, halves up.

Defined cases: null and NaN are left out; zeros, negative markers and extremes count as what they are. A group without
values gives no row. Null grouping values are groups of their own. Infinities count as the greatest finite values. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.functions.buckets import bucket_of, value_of

RELATIVE_ERROR = 0.01
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def bucket_counts(df: DataFrame, values: list[str], groups: list[str], relative_error: float = RELATIVE_ERROR) -> DataFrame:
    """Partial results: (*groups, column_name, bucket, n). They may be stored per load and combined with ``combine``."""
    cells = [F.struct(F.lit(v).alias("column_name"), bucket_of(F.col(f"`{v}`"), relative_error).alias("bucket")) for v in values]
    long = df.select(*[F.col(f"`{g}`") for g in groups], F.explode(F.array(*cells)).alias("cell__")).select(*[f"`{g}`" for g in groups], "cell__.*").where("bucket is not null")
    return long.groupBy(*groups, "column_name", "bucket").agg(F.count(F.lit(1)).alias("n"))


def combine(partials: DataFrame, groups: list[str]) -> DataFrame:
    """Add partial counts up to the groups given, dropping the other group columns."""
    return partials.groupBy(*groups, "column_name", "bucket").agg(F.sum("n").alias("n"))


def combine_sets(partials: DataFrame, groups: list[str], sets: list[tuple[str, ...]]) -> DataFrame:
    """Add partial counts up to several grouping sets in one shuffle; ``grouping`` names the set and other columns are null."""
    rows = [F.struct(F.lit(",".join(s) or "all").alias("grouping"), *[(F.col(f"`{g}`") if g in s else F.lit(None).cast(partials.schema[g].dataType)).alias(g) for g in groups]) for s in sets]
    long = partials.select("column_name", "bucket", "n", F.explode(F.array(*rows)).alias("g__")).select("g__.*", "column_name", "bucket", "n")
    return combine(long, ["grouping", *groups])


def percentiles_by_sets(partials: DataFrame, groups: list[str], sets: list[tuple[str, ...]], relative_error: float = RELATIVE_ERROR) -> DataFrame:
    """``percentiles`` of several grouping sets of partial results, named by ``grouping``. The counts of all columns together are added first, placed
    where their percentiles are taken; the other sets are rolled up from them and are small before they move."""
    whole, keys = tuple(groups), ["grouping", *groups]
    placed = partials.repartition(*[F.col(f"`{g}`") for g in groups], "column_name")
    finest = combine(placed, groups)
    parts = []
    if whole in sets:
        parts.append(percentiles(finest, groups, relative_error).select(F.lit(",".join(whole)).alias("grouping"), "*"))
    if rest := [s for s in sets if s != whole]:
        parts.append(percentiles(combine_sets(finest, groups, rest), keys, relative_error))
    return reduce(DataFrame.unionByName, parts)


def percentiles(counts: DataFrame, keys: list[str], relative_error: float = RELATIVE_ERROR, wanted: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(*keys, column_name, n, p1, ...) from counts per bucket."""
    keys = [*keys, "column_name"]
    part = W.partitionBy(*keys)
    ranked = counts.select("*", F.sum("n").over(part.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)).alias("upto__"), F.sum("n").over(part).alias("all__"))
    rank = lambda p: F.floor(F.lit(float(p)) * (F.col("all__") - 1) / 100.0 + 0.5)
    found = ranked.groupBy(*keys).agg(F.max("all__").alias("n"), *[F.min(F.when(F.col("upto__") > rank(p), F.col("bucket"))).alias(f"p{p}") for p in wanted])
    return found.select(*keys, "n", *[value_of(F.col(f"p{p}"), relative_error).alias(f"p{p}") for p in wanted])
