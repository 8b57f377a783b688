"""Validation of data against a model, and scores of one dataset against another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators.relational import exact_percentiles, ks_distance, total_variation

FINDING = "table_name string, column_name string, finding string, severity string, n long"
#: Data types that may hold a logical type.
COMPATIBLE = {"int": (T.IntegralType,), "float": (T.NumericType,), "string": (T.StringType,), "bool": (T.BooleanType, T.IntegralType), "date": (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType), "datetime": (T.TimestampType, T.TimestampNTZType, T.StringType), "uuid": (T.StringType,), "time": (T.IntegralType, T.StringType)}
WEIGHTS = {"schema": 0.20, "nulls": 0.10, "distribution": 0.40, "correlation": 0.20, "uniqueness": 0.10}


def validate(tables: dict[str, DataFrame], model: dict) -> DataFrame:
    """Findings (table_name, column_name, finding, severity, n): missing and extra columns, incompatible types, nulls where none may be, null or
    duplicate primary keys, row counts out of range, and orphan references. Each table is read once for its counts."""
    spark = next(iter(tables.values())).sparkSession
    fixed, parts = [], []
    for name, spec in model["tables"].items():
        if name not in tables:
            fixed.append((name, None, "missing_table", "error", 1))
            continue
        df, fields = tables[name], spec["fields"]
        for c in fields:
            if c not in df.columns:
                fixed.append((name, c, "missing_column", "error", 1))
            elif not isinstance(df.schema[c].dataType, COMPATIBLE.get(fields[c].get("type", "string"), (T.DataType,))):
                fixed.append((name, c, "incompatible_type", "error", 1))
        fixed += [(name, c, "extra_column", "warning", 1) for c in df.columns if c not in fields]
        aggs, cells = [F.count(F.lit(1)).alias("rows")], []

        def finding(n, c, what, severity="error", name=name):
            return F.struct(F.lit(name).alias("table_name"), F.lit(c).cast("string").alias("column_name"), F.lit(what).alias("finding"), F.lit(severity).alias("severity"), n.cast("long").alias("n"))

        for i, (c, f) in enumerate((c, f) for c, f in fields.items() if c in df.columns):
            if f.get("primary_key"):
                aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"k{i}"), (F.count(c) - F.count_distinct(c)).alias(f"d{i}")]
                cells += [finding(F.col(f"k{i}"), c, "null_primary_key"), finding(F.col(f"d{i}"), c, "duplicate_primary_key")]
            elif f.get("nullable") is False:
                aggs.append(F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}"))
                cells.append(finding(F.col(f"n{i}"), c, "null_in_not_null"))
        low, high = spec.get("rows", (0, 2**62))
        cells.append(finding(F.when(F.col("rows").between(low, high), 0).otherwise(1), None, "row_count_out_of_range"))
        parts.append(df.agg(*aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("n > 0"))
    for r in model.get("relationships", []):
        if r["from_table"] in tables and r["to_table"] in tables:
            refs = tables[r["from_table"]].select(F.col(r["foreign_key"]).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
            keys = tables[r["to_table"]].select(F.col(r["to_column"]).alias("v")).distinct()
            lost = refs.join(keys, "v", "left_anti").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).where("n > 0")
            parts.append(lost.select(F.lit(r["from_table"]).alias("table_name"), F.lit(r["foreign_key"]).alias("column_name"), F.lit("orphan_reference").alias("finding"), F.lit("error").alias("severity"), "n"))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame(fixed, FINDING))


def range_overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(score): overlap of the ranges between the 2nd and 98th percentile, over the original's range; what lies outside costs 1.5 times."""
    a = exact_percentiles(left, [column], [2, 98]).select(F.col("p2").alias("a"), F.col("p98").alias("b"))
    b = exact_percentiles(right, [column], [2, 98]).select(F.col("p2").alias("c"), F.col("p98").alias("d"))
    width = F.col("b") - F.col("a")
    shared = F.greatest(F.lit(0.0), F.least("b", "d") - F.greatest("a", "c"))
    excess = F.greatest(F.lit(0.0), F.col("a") - F.col("c")) + F.greatest(F.lit(0.0), F.col("d") - F.col("b"))
    score = F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared / width - 1.5 * excess / width))).otherwise((F.col("a") == F.col("c")).cast("double"))
    return a.join(F.broadcast(b)).select(score.alias("score"))


def uniqueness(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(score): 1 - 2 * the difference of the shares of distinct values, at least 0."""
    ratio = lambda d, n: d.agg(F.try_divide(F.count_distinct(column), F.count(column)).alias(n))
    return ratio(left, "a").join(F.broadcast(ratio(right, "b"))).select(F.greatest(F.lit(0.0), 1 - 2 * F.abs(F.col("a") - F.col("b"))).alias("score"))


def lengths(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(score) of text lengths: .6 of KS similarity and .4 of range overlap."""
    a, b = (d.select(F.char_length(column).alias("v")) for d in (left, right))
    return ks_distance(a, b, "v").join(F.broadcast(range_overlap(a, b, "v"))).select((0.6 * (1 - F.col("distance")) + 0.4 * F.col("score")).alias("score"))


def correlation_kept(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(score): 1 minus the mean absolute difference of Pearson's r over all pairs of the columns."""
    from fathom.operators.learn.correlate import pearson

    a, b = pearson(left, columns).select("left", "right", F.col("r").alias("a")), pearson(right, columns).select("left", "right", F.col("r").alias("b"))
    return a.join(b, ["left", "right"]).agg((1 - F.avg(F.abs(F.col("a") - F.col("b")))).alias("score"))


def fk_integrity(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(score): the share of non-null references that exist; 1 where there are no references."""
    refs = child.select(F.col(column).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    keys = parent.select(F.col(key).alias("v")).distinct().withColumn("hit", F.lit(True))
    return refs.join(keys, "v", "left").agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("hit"), F.col("k")).otherwise(0)), F.sum("k")), F.lit(1.0)).alias("score"))


def compare_columns(left: DataFrame, right: DataFrame, numeric: list[str], category: list[str]) -> DataFrame:
    """(column_name, measure, score) of shared columns: KS similarity for numbers, total variation similarity for categories, and for all the
    similarity of null rates and of distinct shares."""
    parts = [ks_distance(left, right, c).select(F.lit(c).alias("column_name"), F.lit("ks").alias("measure"), (1 - F.col("distance")).alias("score")) for c in numeric]
    parts += [total_variation(left, right, c).select(F.lit(c).alias("column_name"), F.lit("tv").alias("measure"), F.col("similarity").alias("score")) for c in category]
    for c in [*numeric, *category]:
        parts.append(uniqueness(left, right, c).select(F.lit(c).alias("column_name"), F.lit("uniqueness").alias("measure"), "score"))
        rate = lambda d, n, c=c: d.agg(F.avg(F.col(c).isNull().cast("double")).alias(n))
        parts.append(rate(left, "a").join(F.broadcast(rate(right, "b"))).select(F.lit(c).alias("column_name"), F.lit("nulls").alias("measure"), (1 - F.abs(F.col("a") - F.col("b"))).alias("score")))
    return reduce(DataFrame.unionByName, parts)


def final_score(parts: dict[str, float]) -> float:
    """The weighted mean of part scores; parts that are missing give their weight to the others."""
    used = {k: w for k, w in WEIGHTS.items() if parts.get(k) is not None}
    return sum(parts[k] * w for k, w in used.items()) / sum(used.values()) if used else 0.0
