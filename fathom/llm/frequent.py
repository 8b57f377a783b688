"""Most frequent items among billions: counter summaries per task, a merge tree with error bounds, one exact second pass.

A summary of one column has at most k counters and a deficit d: an item's true count lies between its counter (0 if it has
none) and counter + d, which is the Space-Saving estimate. When more than k items have counters, the (k+1)-th largest counter
is taken off all of them and added to d; this is the Space-Saving summary in its mergeable form, with
d <= n / (k+1) however summaries are split and merged. Memory is k counters and a bounded buffer of rows per task,
whatever the number of distinct values.

Summaries are merged in a tree of fixed fan-in. What survives has an upper bound of at least the wanted share; with k+1 > 1/share
that misses nothing, and at most 1/(share - 1/(k+1)) items per column survive. That proven bound lets them be broadcast for
the second pass, which counts them exactly with map-side combine.

Defined cases: nulls and empty texts are left out, also of the total; values are told apart exactly as written. Ties are
all kept, since an item is in the result by its share alone. An empty column gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = 2000
FAN_IN = 16
BUFFER_ROWS = 200_000
_SCHEMA = "column_name string, bucket long, n long, deficit long, items array<string>, counts array<long>"


def trim(counters: pd.Series, k: int) -> tuple[pd.Series, int]:
    """At most k counters, and what was taken off each."""
    if len(counters) <= k:
        return counters, 0
    values = counters.to_numpy()
    off = int(np.partition(values, len(values) - k - 1)[len(values) - k - 1])
    return (counters - off)[values > off], off


def summarise(batches: Iterator, columns: list[str], k: int, bucket: int) -> Iterator[pd.DataFrame]:
    """Arrow batches to one summary row per column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    state = {c: [pd.Series(dtype="int64"), 0, 0] for c in columns}

    def absorb(held: list) -> None:
        whole = pa.Table.from_batches(held)
        for c in columns:
            col = whole.column(c)
            col = col.filter(pc.fill_null(pc.not_equal(col, ""), False))
            if not len(col):
                continue
            found = pc.value_counts(col)
            fresh = pd.Series(found.field("counts").to_numpy(zero_copy_only=False).astype("int64"), index=pd.Index(found.field("values").to_pandas(), dtype=object))
            kept, deficit, n = state[c]
            fresh, off = trim(fresh.add(kept, fill_value=0).astype("int64") if len(kept) else fresh, k)
            state[c] = [fresh, deficit + off, n + len(col)]

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BUFFER_ROWS:
            absorb(held)
            held, rows = [], 0
    if rows:
        absorb(held)
    for c, (kept, deficit, n) in state.items():
        if n:
            yield pd.DataFrame({"column_name": [c], "bucket": [bucket], "n": [n], "deficit": [deficit], "items": [list(kept.index)], "counts": [kept.tolist()]})


def merge_summaries(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    total = pd.Series(dtype="int64")
    for items, counts in zip(rows["items"], rows["counts"], strict=True):
        more = pd.Series(np.asarray(counts, dtype="int64"), index=pd.Index(list(items), dtype=object))
        total = total.add(more, fill_value=0).astype("int64") if len(total) else more
    total, off = trim(total, k)
    return pd.DataFrame({"column_name": [rows["column_name"].iloc[0]], "bucket": [rows["bucket"].iloc[0]], "n": [rows["n"].sum()], "deficit": [rows["deficit"].sum() + off], "items": [list(total.index)], "counts": [total.tolist()]})


def summaries(df: DataFrame, columns: list[str], k: int = COUNTERS) -> DataFrame:
    """One summary row per column, from summaries per task merged in a tree of fan-in ``FAN_IN``."""
    src = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    tasks = src.rdd.getNumPartitions()  # plans the scan, runs nothing

    def first(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for f in summarise(batches, columns, k, TaskContext.get().partitionId()):
            yield from pa.Table.from_pandas(f, schema=arrow, preserve_index=False).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(_SCHEMA))
    level = src.mapInArrow(first, _SCHEMA)
    while True:
        level = level.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).groupBy("column_name", "bucket").applyInPandas(lambda rows: merge_summaries(rows, k), _SCHEMA)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return level


def candidates(summary: DataFrame, share: Fraction) -> DataFrame:
    """(column_name, item, lower, upper, n): what may hold at least ``share`` of its column."""
    long = summary.select("column_name", "n", "deficit", F.explode(F.arrays_zip("items", "counts")).alias("x"))
    out = long.select("column_name", F.col("x.items").alias("item"), F.col("x.counts").alias("lower"), (F.col("x.counts") + F.col("deficit")).alias("upper"), "n")
    return out.where(F.col("upper") * share.denominator >= F.col("n") * share.numerator)


def frequent(df: DataFrame, columns: list[str], share: str = "0.005", k: int = COUNTERS) -> DataFrame:
    """(column_name, item, lower, upper, count, share) of the items that make up at least ``share`` of their column."""
    least = Fraction(share)
    if not least > Fraction(1, k + 1):
        raise ValueError("more counters are needed: k + 1 must exceed 1 / share")
    from fathom.session import checkpoint

    few = checkpoint(candidates(summaries(df, columns, k), least))
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("item")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    exact = long.join(F.broadcast(few.select("column_name", "item")), ["column_name", "item"]).groupBy("column_name", "item").agg(F.count(F.lit(1)).alias("count"))
    sure = exact.join(F.broadcast(few), ["column_name", "item"])
    return sure.where(F.col("count") * least.denominator >= F.col("n") * least.numerator).select("column_name", "item", "lower", "upper", "count", (F.col("count") / F.col("n")).alias("share"))
