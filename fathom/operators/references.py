"""References to records that do not exist: never made, already deleted, or arriving later.

A reference of a child row is *live* when a record with that key had arrived at or before the child's own time and
was not deleted at or before it. A record arrives with its earliest row; its deletion time is the one on its latest row.

Plan (skew-aware split):

1. Child rows are pre-aggregated per (key, period) to a count and the first and last child time, with map-side
   combine, so a key that holds a third of all rows shrinks to one row per period and task before the shuffle.
2. The aggregate meets the parents, one row per key. A (key, period) whose whole span is live holds no orphan and ends
   there; the others are *suspicious*: wholly orphaned, or mixed.
3. Keys with at least ``1/max_heavy`` of all references are heavy. There are at most ``max_heavy`` of them by
   construction, so their suspicious periods are broadcast and their rows never move. The rows of the remaining keys are
   shuffled on (key, period). Both halves are united.

Defined cases: null references are no references; any other value is one, also 0 and negative numbers. A child row whose
own time is null cannot be placed in time and counts as an orphan only if its key never existed. Parent rows with a null
key are ignored. A record none of whose rows has a time never arrived. Repeated child rows stay repeated in the
orphan rows and are counted each; ``latest_rows`` reduces versioned children to their current row first. Empty tables give
empty results. Only the named columns are read, so further columns and clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.session import checkpoint

MAX_HEAVY = 1000


def latest_rows(df: DataFrame, key: str, time: str) -> DataFrame:
    """One row per ``key``: that with the greatest ``time``. Equal times fall to the greatest of the other columns in
    order, so the choice does not depend on partitioning. Rows whose key is null are dropped. A map-side combine
    keeps one row per key and task, so a hot key does not gather in one place."""
    rest = [c for c in df.columns if c not in (key, time)]
    whole = F.struct(F.col(f"`{time}`"), *[F.col(f"`{c}`") for c in rest])
    best = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__key")).agg(F.max(whole).alias("__row"))
    return best.select(*[(F.col("__key") if c == key else F.col("__row").getField(c)).alias(c) for c in df.columns])


def record_lifetimes(parent: DataFrame, key: str, time: str, deleted: str | None) -> DataFrame:
    """(key, arrived, deleted_at) of each record: its earliest time, and the deletion time on its latest row."""
    gone = F.col(f"`{deleted}`") if deleted else F.lit(None).cast("timestamp_ntz")
    rows = parent.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{time}`").alias("t"), gone.alias("gone"))
    agg = rows.where("key is not null").groupBy("key").agg(F.min("t").alias("arrived"), F.max(F.struct("t", "gone")).alias("last"))
    return agg.select("key", "arrived", F.col("last.gone").alias("deleted_at"))


def _orphaned(t: Column) -> Column:
    """Whether a reference made at ``t`` finds no live record; needs the columns of record_lifetimes."""
    return F.coalesce(F.col("arrived").isNull() | (F.col("arrived") > t) | (F.col("deleted_at") <= t), F.lit(False))


def orphan_rows(
    child: DataFrame,
    reference: str,
    row_key: str,
    time: str,
    parent: DataFrame,
    parent_key: str,
    parent_time: str,
    parent_deleted: str | None = None,
    period: str = "yyyy-MM",
    max_heavy: int = MAX_HEAVY,
) -> DataFrame:
    """Child rows with an orphan reference, as (child_key long, reference long, period string, reason string).

    reason is ``missing`` (no record ever), ``later`` (it arrived after the child) or ``deleted`` (before or with it).
    """
    rows = child.select(
        F.col(f"`{row_key}`").cast("long").alias("child_key"),
        F.col(f"`{reference}`").cast("long").alias("key"),
        F.col(f"`{time}`").alias("t"),
    ).where("key is not null")
    rows = rows.withColumn("period", F.coalesce(F.date_format("t", period), F.lit("")))
    per_key = rows.groupBy("key", "period").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    lives = record_lifetimes(parent, parent_key, parent_time, parent_deleted)
    seen = checkpoint(per_key.join(lives, "key", "left").withColumn("bad", _orphaned(F.col("t0")) | _orphaned(F.col("t1"))))
    total = seen.agg(F.sum("n")).first()[0] or 0
    heavy_at = max(1.0, total / max_heavy)
    weights = seen.groupBy("key").agg(F.sum("n").alias("n"))
    heavy = F.broadcast(weights.where(F.col("n") > heavy_at).select("key"))
    suspicious = seen.where("bad").select("key", "period", "arrived", "deleted_at")
    hot = rows.join(F.broadcast(suspicious.join(heavy, "key", "left_semi")), ["key", "period"])
    cold = rows.join(heavy, "key", "left_anti").join(suspicious.join(heavy, "key", "left_anti"), ["key", "period"])
    reason = F.when(F.col("arrived").isNull(), "missing").when(F.col("arrived") > F.col("t"), "later").otherwise("deleted")
    return (
        hot.unionByName(cold)
        .where(_orphaned(F.col("t")))
        .select("child_key", F.col("key").alias("reference"), F.nullif(F.col("period"), F.lit("")).alias("period"), reason.alias("reason"))
    )


def orphans_of(tables: dict[str, DataFrame], relationships: list[dict], keys: dict[str, str], versioned: set[str] = frozenset(), time: str = "loaded_at", deleted: str = "deleted_at", **options) -> DataFrame:
    """orphan_rows of every foreign key in ``relationships`` (dicts with from_table, foreign_key, to_table, to_column),
    with child_table and child_column in front. ``keys`` names each child's row key; children in ``versioned`` are
    reduced to current rows. The list is a schema, whose size does not depend on the data."""
    out = None
    for r in relationships:
        child, parent = tables[r["from_table"]], tables[r["to_table"]]
        columns = list(dict.fromkeys([keys[r["from_table"]], time, r["foreign_key"]]))
        child = child.select(*columns)
        if r["from_table"] in versioned:
            child = latest_rows(child, keys[r["from_table"]], time)
        found = orphan_rows(child, r["foreign_key"], keys[r["from_table"]], time, parent, r["to_column"], time, deleted if deleted in parent.columns else None, **options)
        found = found.select(F.lit(r["from_table"]).alias("child_table"), F.lit(r["foreign_key"]).alias("child_column"), "*")
        out = found if out is None else out.unionByName(found)
    return out


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan rows per table, column and period, by reason."""
    return orphans.groupBy("child_table", "child_column", "period").agg(
        F.count(F.lit(1)).alias("orphans"),
        *[F.count(F.when(F.col("reason") == r, 1)).alias(f"{r}_rows") for r in ("missing", "later", "deleted")],
    )
