"""Enriching a model with outside data: matching columns by name and type, and judging the match."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Abbreviations that names are expanded by: fixed values.
ABBREVIATIONS = {"qty": "quantity", "amt": "amount", "cust": "customer", "addr": "address", "num": "number", "no": "number", "dt": "date", "ts": "timestamp", "desc": "description", "cat": "category", "acct": "account", "bal": "balance", "emp": "employee", "dept": "department", "prod": "product", "ord": "order", "fname": "first_name", "lname": "last_name", "tel": "phone", "mob": "phone", "mgr": "manager"}


def words(name: str) -> str:
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)
    return "_".join(ABBREVIATIONS.get(p.lower(), p.lower()) for p in parts)


def mapping_scores(spark: SparkSession, left: list[tuple[str, str]], right: list[tuple[str, str]]) -> DataFrame:
    """(left, right, name_score, type_score, score) of all pairs of columns (name, type): .7 of the name's Levenshtein similarity and .3 of the
    type's. The pairs are of two schemas, not of rows."""
    numbers = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    kind = lambda a, b: 1.0 if a == b else 0.7 if {a, b} <= numbers else 0.0
    rows = [(a, b, words(a), words(b), kind(x, y)) for a, x in left for b, y in right]
    df = spark.createDataFrame(rows, "left string, right string, a string, b string, type_score double")
    name = F.when(F.col("a") == F.col("b"), 1.0).otherwise(1 - F.levenshtein("a", "b") / F.greatest(F.lit(1), F.char_length("a"), F.char_length("b")))
    return df.withColumn("name_score", name).select("left", "right", "name_score", "type_score", (0.7 * F.col("name_score") + 0.3 * F.col("type_score")).alias("score"))


def greedy(scores: list[tuple[str, str, float]], least: float = 0.5) -> list[tuple[str, str, float]]:
    """The best pair first, each column once; ties by name."""
    used_a, used_b, out = set(), set(), []
    for a, b, s in sorted(scores, key=lambda x: (-x[2], x[0], x[1])):
        if s >= least and a not in used_a and b not in used_b:
            out.append((a, b, s))
            used_a.add(a)
            used_b.add(b)
    return out


def quality(mapping: float, ks: float, rows: int, null_rate: float = 0.0, type_mismatch: bool = False, range_mismatch: bool = False) -> float:
    """.4 of the mapping score, .35 of the fit (1 - KS) and .25 of the sample size (full at 1000 rows), less penalties for many nulls, another type
    and another range."""
    base = 0.4 * mapping + 0.35 * (1 - ks) + 0.25 * min(1.0, rows / 1000)
    return max(0.0, base - 0.2 * (null_rate > 0.5) - 0.3 * type_mismatch - 0.15 * range_mismatch)


def merge(model: dict, table: str, fits: dict[str, dict]) -> dict:
    """The model with generators of matched fields replaced by fitted ones."""
    t = model["tables"][table]
    fields = {n: (f | {"generator": fits[n]} if n in fits else f) for n, f in t["fields"].items()}
    return model | {"tables": model["tables"] | {table: t | {"fields": fields}}}
