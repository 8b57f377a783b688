"""Incremental learning: mergeable partial results per chunk, kept as table rows.

Frequent values and samples merge as well: the ``k`` most frequent values of a chunk with the count that was left out (so that merged counts have bounds),
and the rows of a chunk with the ``k`` least hashes. Both are cut in two steps, by slices of the hash first, so that no task sorts all
different values or all rows of a chunk.

Partials of a chunk are one row per (table, column) with counts, power sums, extremes and a HyperLogLog sketch, plus co-moments per
pair of numeric columns. Merging adds sums and unites sketches, in any order, to what one pass over all chunks gives. A chunk id
that is already in the state is skipped, so replays change nothing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LG_K = 14


def partials(df: DataFrame, chunk: str, table: str) -> DataFrame:
    """The partial rows of one or many chunks: ``chunk`` names the column that tells chunks apart."""
    aggs, cells = [], []
    for i, f in enumerate(f for f in df.schema.fields if f.name != chunk):
        c = F.col(f"`{f.name}`")
        number = isinstance(f.dataType, T.NumericType)
        x = c.cast("double") if number else F.lit(None).cast("double")
        aggs += [F.count(F.lit(1)).alias(f"r{i}"), F.count(c).alias(f"k{i}"), F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}"), F.hll_sketch_agg(c.cast("string"), LG_K).alias(f"h{i}")]
        cells.append(F.struct(F.lit(f.name).alias("column_name"), F.col(f"r{i}").alias("rows"), F.col(f"k{i}").alias("non_null"), F.col(f"s{i}").alias("s1"), F.col(f"q{i}").alias("s2"), F.col(f"a{i}").alias("low"), F.col(f"z{i}").alias("high"), F.col(f"h{i}").alias("sketch"), F.lit(f.dataType.simpleString()).alias("kind")))
    return df.groupBy(F.col(f"`{chunk}`").cast("string").alias("chunk")).agg(*aggs).select(F.lit(table).alias("table_name"), "chunk", F.explode(F.array(*cells)).alias("x")).select("table_name", "chunk", "x.*")


def ingest(state: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The state with chunks it does not hold yet; known chunk ids are skipped."""
    if state is None:
        return fresh
    return state.unionByName(fresh.join(state.select("table_name", "chunk").distinct(), ["table_name", "chunk"], "left_anti"))


def widened(kinds: list[str]) -> str:
    """The type that holds all types a column had in different chunks."""
    order = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]
    if len(set(kinds)) == 1:
        return kinds[0]
    return max(kinds, key=order.index) if all(k in order[1:] for k in kinds) else "string"


def kind_of(kinds: Column) -> Column:
    """``widened`` of a set of types, as a column."""
    order = ["tinyint", "smallint", "int", "bigint", "float", "double"]
    widest = F.lit(order[0])
    for k in order[1:]:
        widest = F.when(F.array_contains(kinds, k), F.lit(k)).otherwise(widest)
    numbers = F.forall(kinds, lambda k: k.isin(order))
    return F.when(F.size(kinds) == 1, kinds[0]).when(numbers, widest).otherwise("string")


def merged(state: DataFrame) -> DataFrame:
    """(table_name, column_name, kind, rows, null_rate, mean, std, low, high, distinct): the profile of all chunks; kind holds the types of all."""
    s = state.groupBy("table_name", "column_name").agg(F.collect_set("kind").alias("kinds"), F.sum("rows").alias("rows"), F.sum("non_null").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.min("low").alias("low"), F.max("high").alias("high"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    var = F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("n") - 1)
    return s.select("table_name", "column_name", kind_of(F.col("kinds")).alias("kind"), "rows", F.try_divide(F.col("rows") - F.col("n"), F.col("rows")).alias("null_rate"), F.try_divide("s1", "n").alias("mean"), F.sqrt(F.greatest(F.lit(0.0), var)).alias("std"), "low", "high", "distinct")


def comoments(df: DataFrame, chunk: str, columns: list[str]) -> DataFrame:
    """(chunk, left, right, n, sx, sy, sxx, syy, sxy) per pair of numeric columns and chunk."""
    pairs = list(combinations(columns, 2))
    aggs, cells = [], []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
        sums = {"n": F.count(x), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y)}
        aggs += [v.alias(f"{k}{i}") for k, v in sums.items()]
        cells.append(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), *[F.col(f"{k}{i}").alias(k) for k in sums]))
    return df.groupBy(F.col(chunk).cast("string").alias("chunk")).agg(*aggs).select("chunk", F.explode(F.array(*cells)).alias("x")).select("chunk", "x.*")


def correlations(moments: DataFrame) -> DataFrame:
    """(left, right, n, r) from the co-moments of all chunks."""
    s = moments.groupBy("left", "right").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    bottom = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    return s.select("left", "right", "n", F.try_divide(top, bottom).alias("r"))


def coverage(state: DataFrame, child: tuple[str, str], parent: tuple[str, str], name_score: float) -> DataFrame:
    """(coverage, confidence, kept): how much of a reference column lies in a key column, by sketch inclusion and exclusion."""
    pick = lambda t, n: state.where((F.col("table_name") == t[0]) & (F.col("column_name") == t[1])).agg(F.hll_union_agg("sketch").alias(n))
    both = pick(child, "a").join(F.broadcast(pick(parent, "b")))
    a, b, u = F.hll_sketch_estimate("a"), F.hll_sketch_estimate("b"), F.hll_sketch_estimate(F.hll_union("a", "b"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((a + b - u).cast("double"), a.cast("double"))))
    conf = 0.4 * name_score + 0.6 * share
    return both.select(share.alias("coverage"), conf.alias("confidence"), ((conf >= 0.4) & ((share >= 0.5) | F.lit(name_score >= 0.8))).alias("kept"))


SLICES = 64


def _least(df: DataFrame, keys: list[str], order: list[Column], k: int, salt: Column) -> DataFrame:
    """The first ``k`` rows of each key: of each slice first, then of what the slices keep, at most SLICES * k rows a key."""
    cut = df.withColumn("__slice", F.pmod(salt, F.lit(SLICES)))
    first = cut.withColumn("__n", F.row_number().over(W.partitionBy(*keys, "__slice").orderBy(*order))).where(F.col("__n") <= k)
    return first.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__slice", "__n")


def top_partials(df: DataFrame, chunk: str, table: str, columns: list[str], k: int = 1000) -> DataFrame:
    """(table_name, chunk, column_name, value, n, missed): the ``k`` most frequent values of each chunk and column, and the greatest count
    that a value left out can have there (0 if none is)."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    long = df.select(F.col(f"`{chunk}`").cast("string").alias("chunk"), F.explode(F.array(*cells)).alias("x")).select("chunk", "x.*").where("value is not null")
    counts = long.groupBy("chunk", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    top = _least(counts, ["chunk", "column_name"], [F.desc("n"), F.col("value")], k + 1, F.xxhash64("value"))
    ranked = top.withColumn("__r", F.row_number().over(W.partitionBy("chunk", "column_name").orderBy(F.desc("n"), "value")))
    missed = F.coalesce(F.max(F.when(F.col("__r") == k + 1, F.col("n"))).over(W.partitionBy("chunk", "column_name")), F.lit(0))
    return ranked.withColumn("missed", missed).where(F.col("__r") <= k).select(F.lit(table).alias("table_name"), "chunk", "column_name", "value", "n", "missed")


def top_merged(partials: DataFrame, k: int) -> DataFrame:
    """(table_name, column_name, value, lower, upper): the ``k`` most frequent values over all chunks. A count lies between the sum of what the chunks hold
    and that plus what the others may have left out."""
    keys = ["table_name", "column_name"]
    chunks = partials.groupBy(*keys, "chunk").agg(F.max("missed").alias("missed")).groupBy(*keys).agg(F.sum("missed").alias("all"))
    sums = partials.groupBy(*keys, "value").agg(F.sum("n").alias("lower"), F.sum("missed").alias("own"))
    both = sums.join(F.broadcast(chunks), keys).select(*keys, "value", "lower", (F.col("lower") + F.col("all") - F.col("own")).alias("upper"))
    return _least(both, keys, [F.desc("lower"), F.col("value")], k, F.xxhash64("value"))


def reservoir(df: DataFrame, chunk: str, key: list[str], k: int = 10_000, seed: int = 0) -> DataFrame:
    """A uniform sample of up to ``k`` rows of each chunk, those with the least hashes of their key (in __hash); the same however rows are spread."""
    return _least(df.withColumn("__hash", F.xxhash64(F.lit(seed), *key)), [chunk], [F.col("__hash"), *key], k, F.xxhash64(F.lit(seed + 1), *key))


def reservoir_merged(samples: DataFrame, key: list[str], k: int = 10_000) -> DataFrame:
    """The sample of all chunks together that one pass over them would have taken."""
    return _least(samples.withColumn("__all", F.lit(1)), ["__all"], [F.col("__hash"), *key], k, F.xxhash64(F.lit(1), *key)).drop("__all")


def model_of(merged_state: DataFrame, table: str, rows: int, seed: int = 0) -> dict:
    """A blueprint of what the state knows of a table: numbers normal within their range, other columns as words. One row per column."""
    fields: dict = {}
    for r in merged_state.where(F.col("table_name") == table).orderBy("column_name").collect():
        number = r.mean is not None
        whole = r.kind in ("tinyint", "smallint", "int", "bigint")
        g = {"type": "distribution", "family": "normal", "params": {"mean": r.mean, "std_dev": r["std"] or 0.0}, "round": whole} if number else {"type": "faker", "kind": "word"}
        fields[r.column_name] = {"type": ("int" if whole else "float") if number else "string", "generator": g} | ({"null": r.null_rate} if r.null_rate else {})
    limits = [{"range": [r.column_name, r.low, r.high]} for r in merged_state.where((F.col("table_name") == table) & F.col("low").isNotNull()).collect()]
    return {"seed": seed, "tables": {table: {"count": rows, "fields": fields, "constraints": limits}}}
