"""Column-level data quality: profiles per load, character-class masks, and departures from a stored profile.

The backbone is the mask table: every value is generalised to a mask of character classes (``Ab-12`` to ``Aa-9``), and
one pass with map-side combine counts rows per (load, column, mask). Null and empty values keep masks of their own (null and ''), so
null rates, empty string rates, dominant masks, rare-mask violations and the divergence between loads are all sums over this table, whose size
follows the number of masks and not of rows.

How much a mask keeps depends on what is asked of it (``generaliser``). The dominant and rare masks of a column keep classes and what stands between
them. A stored pattern that speaks of whole classes only is decided on masks, once for each and not for each value: on masks that
keep lengths where the pattern counts characters, else on shorter ones. Other patterns, as of hexadecimal digits, tell apart texts
of one mask and are decided on values; columns without pattern keep a mark for any value.

Distinct counts shuffle 64-bit hashes once; medians are counted in logarithmic buckets, or, against a
stored median, decided exactly from counts below and above the limits, so no group is ever sorted or held in one task.

Defined cases: the mask of a null is null and takes part in no rate but the null rate; a rate over no rows is null and
departs from nothing. An empty table gives no rows. Rows with a null load form a load of their own. Text of any length is
masked whole. Distinct counts go by the 64-bit hash of the value's text, so two values in 10^9 distinct ones may coincide
with a probability of about 3 %.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.buckets import bucket_of, bucket_sql, value_of, value_sql
from fathom.session import checkpoint

# Character classes, in the order applied; the last makes one class of letters mixed with digits, such as hex ids.
MASK_STEPS = ((r"[0-9]+", "9"), (r"[A-Z]+", "A"), (r"[a-z]+", "a"), (r"[^\x00-\x7F]+", "u"), (r"[ \t\r\n]+", " "), (r"[Aa9]{4,}", "w"))
MEDIAN_ERROR = 0.005
LIMITS = {"null_rate": 0.08, "empty_string_rate": 0.08, "cardinality_ratio": 0.2, "median": 2.0, "pattern_rate": 0.08, "weights": 0.2}


_CLASSES = {"0-9": ("0123456789", "9"), "A-Z": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), "a-z": ("abcdefghijklmnopqrstuvwxyz", "a")}


_MEMBERS, _MARKS = "".join(c for c, _ in _CLASSES.values()), "".join(m * len(c) for c, m in _CLASSES.values())


def classes(value: Column) -> Column:
    """A text with each digit and ASCII letter replaced by its class; its length stays."""
    return F.translate(value, _MEMBERS, _MARKS)


def runs(value: Column) -> Column:
    """``classes`` with each run of a class made one character."""
    return F.regexp_replace(classes(value), "([9Aa])\\1+", "$1")


def mask(value: Column) -> Column:
    """The character-class mask of a text: what MASK_STEPS make of it, one after the other."""
    short = F.regexp_replace(F.translate(value, _MEMBERS + "\t\r\n", _MARKS + "   "), "([9Aa ])\\1+", "$1")
    return F.regexp_replace(F.regexp_replace(short, MASK_STEPS[3][0], MASK_STEPS[3][1]), MASK_STEPS[5][0], MASK_STEPS[5][1])


_ATOM = re.compile(r"(\[(?:[^\]\\]|\\.)+\]|\\?[^\[\](){}*+?|^$.\\]|\\.)([*+?]|\{[0-9,]+\})?")


def mask_pattern(pattern: str) -> tuple[str, str] | None:
    """("runs" or "classes", pattern over such masks) where a pattern speaks of whole classes of characters only, so that it holds of a value if and
    only if the other holds of its mask; else None. Runs may stand for their class where each class is repeated at will and no two
    parts in a row share one."""
    body = pattern.removeprefix("^").removesuffix("$")
    if not pattern.startswith("^") or body.endswith("\\"):
        return None
    at, made, kind, before = 0, "", "runs", set()
    while at < len(body):
        m = _ATOM.match(body, at)
        if not m or m.group(1).startswith("[^"):
            return None
        atom, times = m.group(1), m.group(2) or ""
        inner = atom[1:-1] if atom.startswith("[") else atom.removeprefix("\\")
        used, rest = set(), inner
        for name, (_, mark) in _CLASSES.items():
            if name in rest and atom.startswith("["):
                rest = rest.replace(name, "", 1)
                used.add(mark)
        # part of a class, a range, or an escape, which masks do not keep apart
        if re.search(r"[A-Za-z0-9\\]", rest) or "-" in rest[1:-1] or not rest.isascii():
            return None
        if used and (times not in ("*", "+") or used & before):
            kind = "classes"
        marks = "".join(sorted(used)) + rest.replace("-", "") + "-" * ("-" in rest)
        made += (f"[{marks}]" if atom.startswith("[") else atom) + times
        before = used | before if times in ("*", "?") or times.startswith("{0") else used
        at = m.end()
    return kind, "^" + made + ("$" if pattern.endswith("$") else "")


def generaliser(pattern: str | None) -> tuple[str, str | None]:
    """Which masks decide a pattern, and the pattern on them: "runs", "classes", or "any" with None where values must decide or nothing is asked."""
    return (pattern and mask_pattern(pattern)) or ("any", None)


def mask_sql(value: str) -> str:
    return reduce(lambda c, step: f"regexp_replace({c}, '{step[0]}', '{step[1]}', 'g')", MASK_STEPS, value)


def _text(df: DataFrame, column: str) -> Column:
    """A value as text; timestamps with all six digits, so that equal values have equal texts everywhere."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c.cast("string")


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _mask_of(df: DataFrame, column: str) -> Column:
    """Masks of numbers come from sign and fraction and need no text."""
    c = F.col(f"`{column}`")
    if _is_text(df, column):
        return mask(c)
    if _is_number(df, column):
        x = c.cast("double")
        body = F.when(F.isnan(x), "NaN").when(x == F.floor(x), "9").otherwise("9.9")
        return F.when(c.isNull(), None).when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)
    return mask(_text(df, column))


def mask_counts(df: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """(load_id, column_name, mask, n): rows per mask."""
    cells = [F.struct(F.lit(c).alias("column_name"), _mask_of(df, c).alias("mask")) for c in columns]
    long = df.select(F.col(f"`{load}`").alias("load_id"), F.explode(F.array(*cells)).alias("cell"))
    return long.groupBy("load_id", "cell.column_name", "cell.mask").agg(F.count(F.lit(1)).alias("n"))


def generalised(df: DataFrame, load: str, patterns: dict[str, str | None], valued: list[str] = []) -> DataFrame:  # noqa: B006
    """(load_id, column_name, mask, hit, n): rows per mask, for each column by the generaliser of its pattern. ``hit`` is whether the pattern holds,
    null where there is none. Columns in ``valued`` are counted a second time, as ``column_name`` with "=" behind it, by their values as text."""
    cells = []
    for c, pattern in patterns.items():
        kind, _ = generaliser(pattern)
        text, col = F.col(f"`{c}`").cast("string"), F.col(f"`{c}`")
        plain = text if _is_text(df, c) else F.lit("*")
        mark = {"runs": runs(text), "classes": classes(text)}.get(kind, F.when(plain == "", "").otherwise("*"))
        hit = text.rlike(pattern) if pattern and kind == "any" else F.lit(None).cast("boolean")
        cells.append(F.struct(F.lit(c).alias("column_name"), F.when(col.isNotNull(), mark).alias("mask"), hit.alias("hit")))
    cells += [F.struct(F.lit(f"{c}=").alias("column_name"), _text(df, c).alias("mask"), F.lit(None).cast("boolean").alias("hit")) for c in valued]
    long = df.select(F.col(f"`{load}`").alias("load_id"), F.explode(F.array(*cells)).alias("cell")).select("load_id", "cell.*")
    counted = long.groupBy("load_id", "column_name", "mask", "hit").agg(F.count(F.lit(1)).alias("n"))
    decided = F.col("hit")
    for c, pattern in patterns.items():
        _, on_mask = generaliser(pattern)
        if on_mask:
            decided = F.when(F.col("column_name") == c, F.col("mask").rlike(on_mask)).otherwise(decided)
    return counted.withColumn("hit", decided)


def mask_rates(masks: DataFrame) -> DataFrame:
    """(load_id, column_name, rows, nulls, empties, matches) from ``generalised``."""
    full = F.col("mask").isNotNull() & (F.col("mask") != "")
    return masks.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("mask").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(F.col("mask") == "", F.col("n")).otherwise(0)).alias("empties"),
        F.sum(F.when(full & F.col("hit"), F.col("n")).otherwise(0)).alias("matches"),
    )


def mask_report(masks: DataFrame, rare: float = 0.005) -> DataFrame:
    """(column_name, load_id, mask, n, share, share_all, is_dominant, is_rare) of non-null, non-empty values: the mask with the most
    rows of its column and load is dominant (of equals, all); a mask that makes up less than ``rare`` of its column over all loads is
    rare, and its rows are violations."""
    # used four times; as a table its size follows the number of masks, so the values are read once
    full = checkpoint(masks.where("mask is not null and mask <> ''"))
    per_load = full.groupBy(F.col("column_name").alias("c_"), F.col("load_id").alias("l_")).agg(F.sum("n").alias("load_n"), F.max("n").alias("top_n"))
    over_all = full.groupBy("column_name", "mask").agg(F.sum("n").alias("mask_n"))
    column_n = full.groupBy("column_name").agg(F.sum("n").alias("column_n"))
    return (
        full.join(per_load, (F.col("column_name") == F.col("c_")) & F.col("load_id").eqNullSafe(F.col("l_")))
        .drop("c_", "l_")
        .join(over_all.join(column_n, "column_name"), ["column_name", "mask"])
        .select("column_name", "load_id", "mask", "n", (F.col("n") / F.col("load_n")).alias("share"), (F.col("mask_n") / F.col("column_n")).alias("share_all"), (F.col("n") == F.col("top_n")).alias("is_dominant"), (F.col("mask_n") < F.lit(rare) * F.col("column_n")).alias("is_rare"))
    )


def mask_divergence(masks: DataFrame) -> DataFrame:
    """(column_name, load_id, values, rare_rows, divergence, divergence_previous): the total variation distance of each load's mask distribution
    from that of all loads together and from that of the load before (null for the first), between 0 and 1, and the rows whose mask is rare. Masks
    a load lacks count by what the others give them, which needs no cross product: half the sum of |p - q| is 1 minus the sum of min(p, q)."""
    full = checkpoint(mask_report(masks))  # its size follows the number of masks
    # loads in order, null first; at most as many rows as columns times loads
    loads = full.select("column_name", "load_id").distinct()
    order = W.partitionBy("column_name").orderBy(F.col("load_id").asc_nulls_first())
    numbered = loads.select(F.col("column_name").alias("c_"), F.col("load_id").alias("l_"), F.row_number().over(order).alias("at"))
    r = full.join(numbered, (F.col("column_name") == F.col("c_")) & F.col("load_id").eqNullSafe(F.col("l_"))).drop("c_", "l_")
    # the share that the load before gives the same mask
    before = r.select("column_name", "mask", (F.col("at") + 1).alias("at"), F.col("share").alias("share_before"))
    r = r.join(before, ["column_name", "mask", "at"], "left")
    return r.groupBy("column_name", "load_id", "at").agg(
        F.sum("n").alias("values"),
        F.sum(F.when(F.col("is_rare"), F.col("n")).otherwise(0)).alias("rare_rows"),
        (F.lit(1.0) - F.sum(F.least("share", "share_all"))).alias("divergence"),
        (F.lit(1.0) - F.sum(F.least(F.col("share"), F.coalesce("share_before", F.lit(0.0))))).alias("gap"),
    ).select("column_name", "load_id", "values", "rare_rows", "divergence", F.when(F.col("at") > 1, F.col("gap")).alias("divergence_previous"))


def dominant_masks(masks: DataFrame, rare: float = 0.005) -> DataFrame:
    """(column_name, mask, n, share, rank): the masks that make up at least ``rare`` of the non-null, non-empty values of a column over all loads, so at
    most 1 / ``rare`` of a column; equal ones share a rank."""
    counts = masks.where("mask is not null and mask <> ''").groupBy("column_name", "mask").agg(F.sum("n").alias("n"))
    total = counts.groupBy("column_name").agg(F.sum("n").alias("total"))  # one row per column
    shared = counts.join(F.broadcast(total), "column_name").withColumn("share", F.col("n") / F.col("total")).where(F.col("n") >= F.lit(rare) * F.col("total"))
    return shared.select("column_name", "mask", "n", "share", F.rank().over(W.partitionBy("column_name").orderBy(F.col("n").desc())).alias("rank"))


def violations(df: DataFrame, load: str, key: str, columns: list[str], rare: float = 0.005) -> DataFrame:
    """(load_id, row_key, column_name, value, mask): the values whose mask is not among the dominant ones of their column. Those are at most
    1 / ``rare`` a column, which bounds what is broadcast; rows with a dominant mask end in the pass that reads them."""
    common = checkpoint(dominant_masks(mask_counts(df, load, columns), rare).select("column_name", "mask"))
    cells = [F.struct(F.lit(c).alias("column_name"), _text(df, c).alias("value"), _mask_of(df, c).alias("mask")) for c in columns]
    long = df.select(F.col(f"`{load}`").alias("load_id"), F.col(f"`{key}`").alias("row_key"), F.explode(F.array(*cells)).alias("x")).select("load_id", "row_key", "x.*")
    return long.where("mask is not null and mask <> ''").join(F.broadcast(common), ["column_name", "mask"], "left_anti").select("load_id", "row_key", "column_name", "value", "mask")


def distinct_counts(df: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """(load_id, column_name, distinct_count) of non-null values."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(_text(df, c))).alias("h")) for c in columns]
    long = df.select(F.col(f"`{load}`").alias("load_id"), F.explode(F.array(*cells)).alias("cell")).select("load_id", "cell.*").where("h is not null")
    return long.distinct().groupBy("load_id", "column_name").agg(F.count(F.lit(1)).alias("distinct_count"))


def bucket_medians(df: DataFrame, load: str, columns: list[str], relative_error: float = MEDIAN_ERROR) -> DataFrame:
    """(load_id, column_name, median) of numeric columns, the lower median within ``relative_error``; groups hold at most a few
    thousand buckets however many rows there are."""
    cells = [F.struct(F.lit(c).alias("column_name"), bucket_of(F.col(f"`{c}`"), relative_error).alias("b")) for c in columns]
    long = df.select(F.col(f"`{load}`").alias("load_id"), F.explode(F.array(*cells)).alias("cell")).select("load_id", "cell.*").where("b is not null")
    counts = long.groupBy("load_id", "column_name", "b").agg(F.count(F.lit(1)).alias("n"))
    part = W.partitionBy("load_id", "column_name")
    ranked = counts.select("*", F.sum("n").over(part.orderBy("b").rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(part).alias("total"))
    hit = ranked.groupBy("load_id", "column_name").agg(F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("b"))).alias("b"))
    return hit.select("load_id", "column_name", value_of(F.col("b"), relative_error).alias("median"))


def profile(df: DataFrame, load: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Per load and column: row_count, null_rate, empty_string_rate (texts only), distinct_count, cardinality_ratio (distinct by
    non-null), min_text and max_text (of texts, times and booleans), min_value and max_value, median (numbers only) and pattern_rate
    (share of non-empty values that match; null without a pattern)."""
    patterns = patterns or {}
    columns = [c for c in df.columns if c != load]
    numbers = [c for c in columns if _is_number(df, c)]
    aggs, cells = [F.count(F.lit(1)).alias("row_count")], []
    for i, c in enumerate(columns):
        col, number = F.col(f"`{c}`"), c in numbers
        full = col.isNotNull() & (col != "") if _is_text(df, c) else col.isNotNull()
        aggs += [F.count(col).alias(f"k{i}"), F.count(F.when(full, 1)).alias(f"f{i}")]
        aggs += [F.min(col.cast("double") if number else _text(df, c)).alias(f"a{i}"), F.max(col.cast("double") if number else _text(df, c)).alias(f"z{i}")]
        if patterns.get(c):
            aggs.append(F.count(F.when(full & col.cast("string").rlike(patterns[c]), 1)).alias(f"m{i}"))
        n = F.col("row_count")
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                n.alias("row_count"),
                F.col(f"k{i}").alias("non_null"),
                ((n - F.col(f"k{i}")) / n).alias("null_rate"),
                ((F.col(f"k{i}") - F.col(f"f{i}")) / n if _is_text(df, c) else F.lit(None).cast("double")).alias("empty_string_rate"),
                (F.lit(None).cast("string") if number else F.col(f"a{i}")).alias("min_text"),
                (F.lit(None).cast("string") if number else F.col(f"z{i}")).alias("max_text"),
                (F.col(f"a{i}") if number else F.lit(None).cast("double")).alias("min_value"),
                (F.col(f"z{i}") if number else F.lit(None).cast("double")).alias("max_value"),
                (F.try_divide(F.col(f"m{i}"), F.col(f"f{i}")) if patterns.get(c) else F.lit(None).cast("double")).alias("pattern_rate"),
            )
        )
    base = df.groupBy(F.col(f"`{load}`").alias("load_id")).agg(*aggs).select("load_id", F.explode(F.array(*cells)).alias("cell")).select("load_id", "cell.*")
    key = ["load_id", "column_name"]
    parts = [distinct_counts(df, load, columns)]
    if numbers:
        parts.append(bucket_medians(df, load, numbers))
    for p in parts:  # one row per load and column
        p = p.select(F.col("load_id").alias("l_"), F.col("column_name").alias("c_"), *[c for c in p.columns if c not in key])
        base = base.join(p, base["load_id"].eqNullSafe(p["l_"]) & (base["column_name"] == p["c_"]), "left").drop("l_", "c_")
    if not numbers:
        base = base.withColumn("median", F.lit(None).cast("double"))
    return base.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0))).withColumn("cardinality_ratio", F.try_divide("distinct_count", "non_null"))


def departures(df: DataFrame, load: str, stored: list[dict], limits: dict[str, float] | None = None) -> DataFrame:
    """(column_name, load_id, metric, measured, stored) of each load of a column whose measure departs from ``stored``.

    ``stored`` holds one dict per column (the profile of a schema, so its size is that of the schema) with column_name and any
    of null_rate, empty_string_rate, cardinality_ratio, median, pattern with pattern_rate, and weights (value to
    share). Measures stored as null are not compared. A median departs when it is more than ``limits['median']`` times
    the stored one or less than its reciprocal; of an even number of values it is the mean of the middle two.
    """
    limit, spark = LIMITS | (limits or {}), df.sparkSession
    stored = [s for s in stored if s["column_name"] in df.columns]
    has = lambda m: {s["column_name"]: s[m] for s in stored if s.get(m) is not None and s[m] == s[m]}
    out = []

    def compare(measured: DataFrame, metric: str, value: Column, departs) -> None:
        kept = has(metric)
        if kept:
            ref = F.create_map(*[F.lit(x) for c, v in kept.items() for x in (c, float(v))])[F.col("column_name")]
            rows = measured.where(F.col("column_name").isin(list(kept))).select("column_name", "load_id", F.lit(metric).alias("metric"), value.alias("measured"), ref.alias("stored"))
            out.append(rows.where(departs(F.col("measured"), F.col("stored"))))

    patterns = {s["column_name"]: s["pattern"] for s in stored if s.get("pattern") and s.get("pattern_rate") is not None}
    counted = [s["column_name"] for s in stored if any(s["column_name"] in has(m) for m in ("null_rate", "empty_string_rate", "pattern_rate"))]
    weights = {s["column_name"]: dict(s["weights"]) for s in stored if s.get("weights")}
    # one pass counts masks and the values that have weights; as a table its size follows the number of masks
    seen = checkpoint(generalised(df, load, {c: patterns.get(c) for c in counted}, list(weights))) if counted or weights else None
    if counted:
        rates = mask_rates(seen.where(F.col("column_name").isin(counted)))
        # one row per load and column, told apart by metric afterwards, so the masks are counted once
        metric_rows = []
        for metric, top, bottom, low in (("null_rate", F.col("nulls"), F.col("rows"), False), ("empty_string_rate", F.col("empties"), F.col("rows"), False), ("pattern_rate", F.col("matches"), F.col("rows") - F.col("nulls") - F.col("empties"), True)):
            kept = has(metric)
            if metric == "pattern_rate":
                kept = {c: v for c, v in kept.items() if c in patterns}
            if not kept:
                continue
            ref = F.create_map(*[F.lit(x) for c, v in kept.items() for x in (c, float(v))])[F.col("column_name")]
            value = F.try_divide(top.cast("double"), bottom.cast("double"))
            gap = ref - value if low else F.abs(value - ref)
            metric_rows.append(F.when(gap > limit[metric], F.struct(F.lit(metric).alias("metric"), value.alias("measured"), ref.alias("stored"))))
        out.append(rates.select("column_name", "load_id", F.explode(F.array_compact(F.array(*metric_rows))).alias("x")).select("column_name", "load_id", "x.*"))

    ratios = has("cardinality_ratio")
    if ratios:
        names = list(ratios)
        found = distinct_counts(df, load, names)
        full = df.groupBy(F.col(f"`{load}`").alias("load_id")).agg(*[F.count(f"`{c}`").alias(c) for c in names])
        full = full.select(F.col("load_id").alias("l_"), F.explode(F.array(*[F.struct(F.lit(c).alias("c_"), F.col(f"`{c}`").alias("k_")) for c in names])).alias("x")).select("l_", "x.*")
        both = found.join(full, found["load_id"].eqNullSafe(F.col("l_")) & (F.col("column_name") == F.col("c_")))
        compare(both, "cardinality_ratio", F.col("distinct_count") / F.col("k_"), lambda m, s: F.abs(m - s) > limit["cardinality_ratio"])

    medians = has("median")
    if medians:
        cells, aggs = [], []
        for i, (c, s) in enumerate(medians.items()):
            x = F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
            marks = {"h": limit["median"] * s, "l": s / limit["median"]}
            aggs.append(F.count(x).alias(f"n{i}"))
            for k, at in marks.items():
                aggs += [F.count(F.when(x <= at, 1)).alias(f"{k}c{i}"), F.max(F.when(x <= at, x)).alias(f"{k}a{i}"), F.min(F.when(x > at, x)).alias(f"{k}b{i}")]
                # for "less than": the same with < and >=
                aggs += [F.count(F.when(x < at, 1)).alias(f"{k}d{i}"), F.max(F.when(x < at, x)).alias(f"{k}e{i}"), F.min(F.when(x >= at, x)).alias(f"{k}f{i}")]
            n = F.col(f"n{i}")
            above = F.when(F.col(f"hc{i}") * 2 == n, (F.col(f"ha{i}") + F.col(f"hb{i}")) / 2 > marks["h"]).otherwise(F.col(f"hc{i}") * 2 < n)
            below = F.when(F.col(f"ld{i}") * 2 == n, (F.col(f"le{i}") + F.col(f"lf{i}")) / 2 < marks["l"]).otherwise(F.col(f"ld{i}") * 2 > n)
            # what is known of the median itself is the limit it passed
            passed = F.when(above, marks["h"]).when(below, marks["l"])
            cells.append(F.when((n > 0) & (above | below), F.struct(F.lit(c).alias("column_name"), F.lit("median").alias("metric"), passed.alias("measured"), F.lit(float(s)).alias("stored"))))
        per_load = df.groupBy(F.col(f"`{load}`").alias("load_id")).agg(*aggs)
        out.append(per_load.select("load_id", F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.column_name", "load_id", "x.metric", "x.measured", "x.stored"))

    if weights:
        marked = F.create_map(*[F.lit(x) for c in weights for x in (f"{c}=", c)])[F.col("column_name")]
        counts = seen.where(F.col("mask").isNotNull()).select("load_id", marked.alias("column_name"), F.col("mask").alias("item"), "n").where("column_name is not null")
        known = spark.createDataFrame([(c, k, float(w)) for c, ws in weights.items() for k, w in ws.items()], "column_name string, item string, w double")
        totals = F.create_map(*[F.lit(x) for c, ws in weights.items() for x in (c, float(sum(ws.values())))])[F.col("column_name")]
        # sum |p - w| over the union = sum over values present of (|p - w| - w) + sum of all w
        joined = counts.join(F.broadcast(known), ["column_name", "item"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
        sums = joined.groupBy("load_id", "column_name").agg(F.sum("n").alias("total"), F.collect_list(F.when(F.col("w") > 0, F.struct("n", "w"))).alias("named"), F.sum(F.when(F.col("w") == 0, F.col("n")).otherwise(0)).alias("other"))
        gap = F.aggregate("named", F.lit(0.0), lambda a, v: a + F.abs(v["n"] / F.col("total") - v["w"]) - v["w"])
        sums = sums.withColumn("tv", (gap + F.col("other") / F.col("total") + totals) / 2)
        out.append(sums.where(F.col("tv") > limit["weights"]).select("column_name", "load_id", F.lit("weights").alias("metric"), F.col("tv").alias("measured"), F.lit(0.0).alias("stored")))

    if not out:
        return spark.createDataFrame([], "column_name string, load_id int, metric string, measured double, stored double")
    return reduce(DataFrame.unionByName, out)


__all__ = ["bucket_medians", "bucket_sql", "departures", "distinct_counts", "dominant_masks", "generalised", "mask", "mask_counts", "mask_divergence", "mask_report", "mask_sql", "profile", "value_sql", "violations"]
