"""Relational building blocks: distributed prefix sums and ranks, lookups, causal joins, sampling, set measures.

Global ranks and running totals never use an unpartitioned window, which would gather all rows in one task. Rows are
range-partitioned by the order, totals run within partitions, and each partition is lifted by the sum of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathom.session import checkpoint

BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which is checked; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows range-partitioned by keys and order, with the partition's number in __ps_part. The checkpoint fixes the boundaries, which Spark
    samples anew in every run. A key of any size is spread over as many partitions as its order allows."""
    ranged = df.repartitionByRange(*[F.col(f"`{c}`").asc_nulls_first() for c in [*keys, *order]])
    return checkpoint(ranged.withColumn("__ps_part", F.spark_partition_id()))


def prefix_scan(df: DataFrame, order: list[str], value: Column, keys: list[str] = [], name: str = "upto", how: str = "sum") -> DataFrame:  # noqa: B006
    """Add ``name``: the sum (or, with how="max", the maximum) of ``value`` over this row and those before it by ``order`` within ``keys``.

    ``order`` must not have ties across rows if results are to be exact per row; equal rows get consecutive sums.
    """
    agg = {"sum": F.sum, "max": F.max}[how]
    ranged = _ranged(df.withColumn("__ps_value", value), keys, order)
    here = W.partitionBy("__ps_part", *keys).orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    totals = ranged.groupBy("__ps_part", *keys).agg(agg("__ps_value").alias("__ps_total"))
    before = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    # one row per partition and key that it holds: usually no more than partitions + keys
    lifted = totals.withColumn("__ps_offset", agg("__ps_total").over(before.orderBy("__ps_part").rowsBetween(W.unboundedPreceding, -1)))
    keyed = lifted.select(F.col("__ps_part").alias("__ps_part2"), "__ps_offset", *[F.col(f"`{k}`").alias(f"__ps_key{i}") for i, k in enumerate(keys)])
    match = F.col("__ps_part") == F.col("__ps_part2")
    for i, k in enumerate(keys):
        match &= F.col(f"`{k}`").eqNullSafe(F.col(f"__ps_key{i}"))
    out = ranged.withColumn("__ps_here", agg("__ps_value").over(here)).join(keyed, match)
    total = F.col("__ps_here") + F.coalesce(F.col("__ps_offset"), F.lit(0)) if how == "sum" else F.greatest("__ps_here", "__ps_offset")
    return out.select(*df.columns, total.alias(name))


def prefix_sums(df: DataFrame, order: list[str], value: Column, keys: list[str] = [], name: str = "upto") -> DataFrame:  # noqa: B006
    """prefix_scan with sums."""
    return prefix_scan(df, order, value, keys, name)


def lagged(df: DataFrame, keys: list[str], order: list[str], column: str, name: str = "previous") -> DataFrame:
    """Add ``name``: the value of ``column`` on the row before by ``order`` within ``keys``; null on the first.

    Where a partition begins within a key, the value comes from the last row of the partition before that holds the key, so a key
    that holds a third of all rows is not gathered in one task.
    """
    ranged = _ranged(df, keys, order)
    sort = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    here = W.partitionBy("__ps_part", *keys).orderBy(*sort)
    ends = ranged.groupBy("__ps_part", *keys).agg(F.max_by(F.struct(F.col(f"`{column}`").alias("v")), F.struct(*[F.col(f"`{c}`") for c in order])).alias("__ps_last"))
    before = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("__ps_part")
    carried = ends.select(F.col("__ps_part").alias("__ps_part2"), F.lag("__ps_last").over(before).getField("v").alias("__ps_carry"), *[F.col(f"`{k}`").alias(f"__ps_key{i}") for i, k in enumerate(keys)])
    match = F.col("__ps_part") == F.col("__ps_part2")
    for i, k in enumerate(keys):
        match &= F.col(f"`{k}`").eqNullSafe(F.col(f"__ps_key{i}"))
    rows = ranged.withColumn("__ps_n", F.row_number().over(here)).withColumn("__ps_lag", F.lag(f"`{column}`").over(here)).join(carried, match)
    return rows.select(*df.columns, F.when(F.col("__ps_n") > 1, F.col("__ps_lag")).otherwise(F.col("__ps_carry")).alias(name))


def row_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Add a dense 0-based row number over the order of the columns given."""
    return prefix_sums(df, order, F.lit(1).cast("long"), name=name).withColumn(name, F.col(name) - 1)


def average_ranks(df: DataFrame, column: str, name: str = "rank", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(*keys, column, name): the average rank, from 1, of each distinct non-null value. Ties share the mean of their ranks."""
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    upto = prefix_sums(counts, [column], F.col("__n"), keys, "__upto")
    return upto.select(*keys, column, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))


def exact_percentiles(df: DataFrame, columns: list[str], wanted: list[int]) -> DataFrame:
    """(column_name, p1, ...) of numeric columns: the value at index round(p/100*(n-1)) in ascending order."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("value is not null and not isnan(value)")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = prefix_sums(counts, ["value"], F.col("n"), ["column_name"])
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))  # one row per column
    at = lambda p: F.floor(F.lit(float(p)) * (F.col("total") - 1) / 100.0 + 0.5)
    return upto.join(F.broadcast(totals), "column_name").groupBy("column_name").agg(*[F.min(F.when(F.col("upto") > at(p), F.col("value"))).alias(f"p{p}") for p in wanted])


def overlap(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(values, found, overlap): distinct non-null values of a column and the share that exists in another (semi join)."""
    values = child.select(F.col(f"`{column}`").alias("v")).where("v is not null").distinct()
    there = parent.select(F.col(f"`{key}`").alias("v")).where("v is not null").distinct().withColumn("hit", F.lit(1))
    return values.join(there, "v", "left").agg(F.count(F.lit(1)).alias("values"), F.count("hit").alias("found"), F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("overlap"))


def causal_join(child: DataFrame, key: str, time: str, parent: DataFrame, parent_key: str, parent_time: str) -> DataFrame:
    """Child rows whose ``time`` is raised to that of their parent where it came before."""
    p = parent.select(F.col(f"`{parent_key}`").alias(key), F.col(f"`{parent_time}`").alias("__parent_time"))
    return child.join(p, key, "left").withColumn(time, F.greatest(F.col(time), F.col("__parent_time"))).select(*child.columns)


def enforce_gap(df: DataFrame, actor: str, time: str, gap_ms: int, tie: list[str] = []) -> DataFrame:  # noqa: B006
    """Times moved so that consecutive rows of an actor are at least ``gap_ms`` apart: t' = max(t, previous t' + gap), which is the running
    maximum of t - gap * n, plus gap * n. Both are distributed scans, so an actor may hold any share of the rows."""
    numbered = prefix_sums(df, [time, *tie], F.lit(1).cast("long"), [actor], "__gap_n")
    at = F.unix_millis(F.col(time).cast("timestamp")) - F.lit(gap_ms) * F.col("__gap_n")
    top = prefix_scan(numbered, ["__gap_n"], at, [actor], "__gap_top", "max")
    moved = F.timestamp_millis(F.col("__gap_top") + F.lit(gap_ms) * F.col("__gap_n"))
    return top.withColumn(time, moved).select(*df.columns)


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """A uniform sample of n rows without replacement, the same however the rows are partitioned: the n least hashes of the key. Only rows below a bound
    that leaves some more than n of them are sorted; should they be too few, which hardly ever happens, all are."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in key]))
    rows = df.count()
    share = (n + 10 * n**0.5 + 100) / rows if rows else 1.0
    if share < 0.5:
        few = df.where(digest <= F.lit(f"{int(share * 16**8):08x}" + "f" * 24))
        if few.limit(n).count() == n:
            df = few
    return df.orderBy(digest, *key).limit(n)


def head_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def total_variation(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(similarity): 1 minus half the sum of absolute differences between two distributions of non-null values."""
    side = lambda d, n: d.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("v")).agg(F.count(F.lit(1)).alias(n))
    both = side(left, "a").join(side(right, "b"), "v", "full_outer")
    sums = both.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.coalesce("a", F.lit(0)) / F.col("na") - F.coalesce("b", F.lit(0)) / F.col("nb"))
    return both.join(F.broadcast(sums)).agg((F.lit(1.0) - F.sum(gap) / 2).alias("similarity"))


def ks_distance(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(distance): the greatest gap between the empirical distributions of two samples, over all values of either."""
    side = lambda d, a, b: d.select(F.col(f"`{column}`").cast("double").alias("v"), F.lit(a).alias("a"), F.lit(b).alias("b")).where("v is not null and not isnan(v)")
    counts = checkpoint(side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    ends = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))  # one row
    steps = counts.join(F.broadcast(ends)).withColumn("step", F.try_divide("a", "na") - F.try_divide("b", "nb"))
    return prefix_sums(steps.select("v", "step"), ["v"], F.col("step")).agg(F.max(F.abs("upto")).alias("distance"))
