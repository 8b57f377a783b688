"""Primary and foreign keys by names and values."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.relational import overlap

#: Suffixes that mark a column as a reference: fixed values.
SUFFIXES = ("_id", "_key", "_fk", "Id", "ID", "Key", "_ref")
LEAST_NAME, LEAST_OVERLAP, UNIQUE_SHARE = 0.3, 0.1, 0.95


def looks_like_id(name: str, relaxed: bool = False) -> bool:
    """Whether a column name is that of a key. ``relaxed`` also takes a short table prefix and a bare ``key`` suffix."""
    n = _plain(name) if relaxed else name
    low = n.lower()
    return low in ("id", "uuid", "guid", "key") or low.endswith("_uuid") or n.endswith(SUFFIXES) or (relaxed and low.endswith("key"))


def _plain(name: str) -> str:
    return re.sub(r"^[a-z]{1,2}_", "", name)


def stem(name: str, relaxed: bool = False) -> str:
    """A reference column's name without its suffix."""
    n = _plain(name) if relaxed else name
    for s in SUFFIXES:
        if n.endswith(s) and len(n) > len(s):
            return n[: -len(s)].lower().rstrip("_")
    return n[:-3].lower().rstrip("_") if relaxed and n.lower().endswith("key") and len(n) > 3 else n.lower()


def name_score(column: str, table: str, relaxed: bool = False) -> float:
    """How well a reference column names a table: 1 the same, .9 its plural or singular, .6 one within the other, else 0."""
    a, b = stem(column, relaxed), table.lower()
    if a == b:
        return 1.0
    if a + "s" == b or b + "s" == a or a + "es" == b or (a.endswith("y") and a[:-1] + "ies" == b):
        return 0.9
    return 0.6 if a and (a in b or b in a) else 0.0


def primary_keys(tables: dict[str, DataFrame], relaxed: bool = False) -> DataFrame:
    """(table_name, column_name, rows, distinct, is_key) of columns with the name of a key: a key is unique and has no nulls."""
    out = None
    for name, df in tables.items():
        ids = [c for c in df.columns if looks_like_id(c, relaxed)]
        if not ids:
            continue
        aggs = [m for i, c in enumerate(ids) for m in (F.count(f"`{c}`").alias(f"k{i}"), F.count_distinct(f"`{c}`").alias(f"d{i}"))]
        cells = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col("rows"), F.col(f"d{i}").alias("distinct"), ((F.col(f"k{i}") == F.col("rows")) & (F.col(f"d{i}") == F.col("rows"))).alias("is_key")) for i, c in enumerate(ids)]
        part = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).select(F.explode(F.array(*cells)).alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part)
    return out


def chosen_key(found: list[dict], table: str) -> str | None:
    """Of several keys of a table (rows of primary_keys): the one called id, else one named after the table, else the first by name."""
    names = sorted(r["column_name"] for r in found if r["table_name"] == table and r["is_key"])
    return max(names, key=lambda n: (n.lower() == "id", name_score(n, table), [-ord(ch) for ch in n]), default=None)


def foreign_keys(tables: dict[str, DataFrame], keys: dict[str, str], relaxed: bool = False) -> DataFrame:
    """(from_table, from_column, to_table, to_column, name_score, overlap, kind, confidence) of columns whose name points to a table
    and whose values are found there. kind is one_to_one if at least 95 % of the values are unique."""
    parts = []
    for child, df in tables.items():
        for column in df.columns:
            if column == keys.get(child) or not looks_like_id(column, relaxed):
                continue
            for parent, key in keys.items():
                score = name_score(column, parent, relaxed)
                if score < LEAST_NAME or (parent == child and column == key) or parent not in tables:
                    continue
                unique = df.agg(F.try_divide(F.count_distinct(column), F.count(column)).alias("unique"))
                row = overlap(df, column, tables[parent], key).join(F.broadcast(unique))
                confidence = 0.4 * score + 0.4 * F.col("overlap") + 0.1 * (1.0 if column.lower().endswith("id") else 0.0) + 0.1
                parts.append(row.where(F.col("overlap") >= LEAST_OVERLAP).select(F.lit(child).alias("from_table"), F.lit(column).alias("from_column"), F.lit(parent).alias("to_table"), F.lit(key).alias("to_column"), F.lit(score).alias("name_score"), "overlap", F.when(F.col("unique") >= UNIQUE_SHARE, "one_to_one").otherwise("many_to_one").alias("kind"), confidence.alias("confidence")))
    return reduce(DataFrame.unionByName, parts)
