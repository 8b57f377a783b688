"""Rescaling a model: which dimensions its tables grow along, and how many rows each gets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a value of a type takes: fixed values of the estimate.
BYTES = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.LongType: 8, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}


@dataclass
class Plan:
    """Factors by which tables grow: actors scale their dependents, time scales series, dimensions their values."""

    actors: dict[str, float] = field(default_factory=dict)
    time: dict[str, float] = field(default_factory=dict)
    dimensions: dict[str, float] = field(default_factory=dict)
    density: float = 1.0
    uniform: float = 1.0


def dimensions(tables: dict[str, DataFrame], actors: list[str], references: list[tuple[str, str, str]]) -> DataFrame:
    """(table_name, kind, rows, ratio): actors; their dependents with rows per actor; and small tables (up to 20 rows, or under a tenth of the
    rows that refer to them) as custom dimensions. References are (child, column, parent)."""
    counts = None
    for n, df in tables.items():
        c = df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        counts = c if counts is None else counts.unionByName(c)
    spark = next(iter(tables.values())).sparkSession
    links = counts.join(spark.createDataFrame([(c, p) for c, _, p in references] or [("", "")], "table_name string, parent string"), "table_name", "left")
    parents = counts.select(F.col("table_name").alias("parent"), F.col("rows").alias("parent_rows"))
    joined = links.join(parents, "parent", "left").groupBy("table_name", "rows").agg(F.max(F.when(F.col("parent").isin(actors), F.col("rows") / F.col("parent_rows"))).alias("ratio"))
    referring = links.where("parent is not null").groupBy(F.col("parent").alias("table_name")).agg(F.max("rows").alias("child_rows"))
    both = joined.join(referring, "table_name", "left")
    kind = F.when(F.col("table_name").isin(actors), "actor").when(F.col("ratio").isNotNull(), "dependent").when((F.col("rows") <= 20) | (F.col("rows") / F.col("child_rows") < 0.1), "dimension").otherwise("fixed")
    return both.select("table_name", kind.alias("kind"), "rows", "ratio")


def planned_rows(counts: DataFrame, plan: Plan, parents: dict[str, str]) -> DataFrame:
    """(table_name, rows, planned): the factors apply in order actors, time, dimensions, density, uniform; results are rounded, at least 1.
    ``parents`` names the actor each dependent table follows."""

    def factor(table: str) -> float:
        own = plan.actors.get(table, plan.actors.get(parents.get(table, ""), 1.0))
        density = plan.density if table in parents else 1.0
        return own * plan.time.get(table, 1.0) * plan.dimensions.get(table, 1.0) * density * plan.uniform

    names = sorted({*parents, *parents.values(), *plan.actors, *plan.time, *plan.dimensions})
    chosen = F.lit(plan.uniform)
    if names:
        chosen = F.coalesce(F.create_map(*[F.lit(x) for n in names for x in (n, factor(n))])[F.col("table_name")], chosen)
    return counts.select("table_name", "rows", F.greatest(F.lit(1), F.round(F.col("rows") * chosen)).cast("long").alias("planned"))


def cadence(df: DataFrame, column: str) -> DataFrame:
    """(days, n): the gaps between the distinct days of a column, most frequent first. Distinct days are few (a century has 36 525)."""
    days = df.select(F.to_date(column).alias("d")).where("d is not null").distinct()
    gaps = days.select(F.datediff("d", F.lag("d").over(W.partitionBy(F.lit(1)).orderBy("d"))).alias("days")).where("days is not null")
    return gaps.groupBy("days").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "days")


def steps(start: date, end: date, kind: str, every: int = 1) -> list[date]:
    """Dates from start to end: every so many days or months, or ends of months."""
    out, i = [], 0
    while True:
        if kind == "days":
            d = start + timedelta(days=i * every)
        else:
            m = start.month - 1 + i * every
            y, m = start.year + m // 12, m % 12 + 1
            last = (date(y + m // 12, m % 12 + 1, 1) - timedelta(days=1)).day
            d = date(y, m, last if kind == "month_end" else min(start.day, last))
        if d > end:
            return out
        out.append(d)
        i += 1


def new_values(values: list[str], n: int) -> list[str]:
    """n further values in the manner of those given: numbers go on, numbered texts go on, letters go on, else numbered copies."""
    taken, out = set(values), []
    if values and all(re.fullmatch(r"-?\d+", v) for v in values):
        at, made = max(map(int, values)), str
    elif values and all(re.fullmatch(r"[A-Z]", v) for v in values):
        at, made = ord(max(values)) - 65, lambda i: (chr(65 + i) if i < 26 else f"{chr(65 + i // 26 - 1)}{chr(65 + i % 26)}")
    elif values and all(m := [re.fullmatch(r"(.*?)(\d+)", v) for v in values]) and len({x[1] for x in m}) == 1:
        width, prefix = len(m[0][2]), m[0][1]
        at, made = max(int(x[2]) for x in m), lambda i: f"{prefix}{i:0{width}d}"
    else:
        at, made = 0, lambda i: f"{values[(i - 1) % len(values)] if values else 'value'}_{(i - 1) // max(1, len(values)) + 2}"
    while len(out) < n:
        at += 1
        if (v := made(at)) not in taken:
            out.append(v)
    return out


def row_bytes(df: DataFrame) -> DataFrame:
    """(rows, bytes_per_row, bytes): the estimated size, texts by their mean length."""
    fixed = sum(next((b for t, b in BYTES.items() if isinstance(f.dataType, t)), 0) for f in df.schema.fields)
    texts: list[Column] = [F.coalesce(F.avg(F.char_length(f"`{f.name}`")), F.lit(0.0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    per = sum(texts, F.lit(float(fixed)))
    return df.agg(F.count(F.lit(1)).alias("rows"), per.alias("bytes_per_row")).withColumn("bytes", F.col("rows") * F.col("bytes_per_row"))


def rewrite(model: dict, planned: dict[str, int]) -> dict:
    """The model with new row counts."""
    return model | {"tables": {n: t | {"count": planned.get(n, t.get("count", 1))} for n, t in model["tables"].items()}}
