"""Controlled data-quality faults: perturbators with a rate, a column list and a row predicate.

Every decision is a hash of (seed, perturbator, column, row key), so the same rows are hit whatever the partitioning. A predicate is
evaluated once against the original rows (nulls count as false). Value drift, outlier ranges and swaps are defined per table.
Stages tell what a perturbator may break: nothing (clean), column constraints (constrained), keys (breaking).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.expressions import compile_expression
from fathom.functions.rng import Rng
from fathom.operators.relational import prefix_sums, row_index

STAGES = {
    "null": "constrained", "gaussian": "clean", "typo": "constrained", "outlier": "constrained", "duplicate": "breaking", "drift": "constrained",
    "format": "constrained", "swap": "clean", "truncate": "breaking", "fk_violate": "breaking", "temporal_spike": "constrained",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Scope:
    """Which rows a perturbator hits: ``key`` identifies rows, ``rate`` of those that fulfil ``where`` are chosen."""

    key: str
    rate: float
    seed: int = 0
    where: str | None = None
    portable: bool = False

    def rng(self, df: DataFrame, name: str) -> Rng:
        return Rng(self.seed, name, F.col(f"`{self.key}`").cast("string"), self.portable)

    def hit(self, df: DataFrame, name: str, column: str) -> Column:
        chosen = self.rng(df, name).uniform(column, "hit") < self.rate
        return chosen & F.coalesce(compile_expression(self.where, df.schema), F.lit(False)) if self.where else chosen


def _replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return df.select(*[changed[c].cast(df.schema[c].dataType).alias(c) if c in changed else F.col(f"`{c}`") for c in df.columns])


def inject_nulls(df: DataFrame, columns: list[str], scope: Scope) -> DataFrame:
    return _replace(df, {c: F.when(~scope.hit(df, "null", c), F.col(f"`{c}`")) for c in columns})


def add_gaussian(df: DataFrame, columns: list[str], scope: Scope, sigma: float, relative: bool = False) -> DataFrame:
    """x + N(0, sigma), or x * (1 + N(0, sigma)); integers stay integers."""
    out = {}
    for c in columns:
        x, z = F.col(f"`{c}`").cast("double"), scope.rng(df, "gaussian").normal(c) * sigma
        moved = x * (1 + z) if relative else x + z
        if isinstance(df.schema[c].dataType, T.IntegralType):
            moved = F.round(moved)
        out[c] = F.when(scope.hit(df, "gaussian", c), moved).otherwise(F.col(f"`{c}`"))
    return _replace(df, out)


def inject_typos(df: DataFrame, columns: list[str], scope: Scope) -> DataFrame:
    """Swap two neighbours, insert, delete or substitute a letter, with equal chance. Texts of fewer than two letters stay."""
    out = {}
    for c in columns:
        s, rng = F.col(f"`{c}`"), scope.rng(df, "typo")
        n = F.char_length(s)
        at = rng.integer(1, n - 1, c, "at").cast("int")
        letter = F.substring(F.lit(LETTERS), rng.integer(1, 26, c, "letter").cast("int"), F.lit(1))
        kind = rng.integer(0, 3, c, "kind")
        head, one, two, rest = F.substring(s, F.lit(1), at - 1), F.substring(s, at, F.lit(1)), F.substring(s, at + 1, F.lit(1)), F.substring(s, at + 2, n)
        made = F.when(kind == 0, F.concat(head, two, one, rest)).when(kind == 1, F.concat(head, one, letter, two, rest)).when(kind == 2, F.concat(head, two, rest)).otherwise(F.concat(head, letter, two, rest))
        out[c] = F.when(scope.hit(df, "typo", c) & (n >= 2), made).otherwise(s)
    return _replace(df, out)


def inject_outliers(df: DataFrame, columns: list[str], scope: Scope, multiplier: float = 5.0) -> DataFrame:
    """x plus or minus max(range, 1) * multiplier; the ranges of all columns are one broadcast row."""
    spans = df.agg(*[(F.max(f"`{c}`").cast("double") - F.min(f"`{c}`").cast("double")).alias(f"__w{i}") for i, c in enumerate(columns)])
    wide = df.join(F.broadcast(spans))
    out = {}
    for i, c in enumerate(columns):
        sign = F.when(scope.rng(df, "outlier").uniform(c, "sign") < 0.5, -1.0).otherwise(1.0)
        out[c] = F.when(scope.hit(df, "outlier", c), F.col(f"`{c}`").cast("double") + sign * F.greatest(F.col(f"__w{i}"), F.lit(1.0)) * multiplier).otherwise(F.col(f"`{c}`").cast("double"))
    return _replace(wide, out).select(*df.columns)


def append_duplicates(df: DataFrame, scope: Scope) -> DataFrame:
    return df.unionByName(df.where(scope.hit(df, "duplicate", "*")))


def drift_values(df: DataFrame, columns: list[str], scope: Scope, per_row: float) -> DataFrame:
    """x + per_row * row number, rows counted from 0 in key order over the table."""
    indexed = row_index(df, [scope.key], "__row")
    out = {c: F.when(scope.hit(df, "drift", c), F.col(f"`{c}`").cast("double") + per_row * F.col("__row")).otherwise(F.col(f"`{c}`").cast("double")) for c in columns}
    return _replace(indexed, out).select(*df.columns)


def corrupt_formats(df: DataFrame, columns: list[str], scope: Scope) -> DataFrame:
    """Emails lose their @, dates get slashes, urls lose their scheme's colon, other texts change case."""
    out = {}
    for c in columns:
        s = F.col(f"`{c}`")
        bad = F.when(s.rlike(r"^\S+@\S+$"), F.regexp_replace(s, "@", "")).when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.replace(s, F.lit("-"), F.lit("/"))).when(s.rlike(r"^https?://"), F.regexp_replace(s, "://", "//")).otherwise(F.when(s == F.upper(s), F.lower(s)).otherwise(F.upper(s)))
        out[c] = F.when(scope.hit(df, "format", c), bad).otherwise(s)
    return _replace(df, out)


def swap_values(df: DataFrame, column: str, scope: Scope) -> DataFrame:
    """Chosen rows exchange values in pairs of neighbours by key; the values of the column stay the same multiset. The last of an odd
    number keeps its value."""
    hit = scope.hit(df, "swap", column)
    chosen = prefix_sums(df.where(hit).select(F.col(f"`{scope.key}`").alias("__k"), F.col(f"`{column}`").alias("__v")), ["__k"], F.lit(1).cast("long"), name="__i")
    mate = chosen.select((F.when(F.col("__i") % 2 == 1, F.col("__i") + 1).otherwise(F.col("__i") - 1)).alias("__i"), F.col("__v").alias("__w"), F.lit(True).alias("__mate"))
    moved = chosen.join(mate, "__i", "left").select("__k", F.when(F.col("__mate"), F.col("__w")).otherwise(F.col("__v")).alias("__w"), F.lit(True).alias("__hit"))
    joined = df.join(moved, df[scope.key] == moved["__k"], "left")
    return _replace(joined, {column: F.when(F.col("__hit"), F.col("__w")).otherwise(F.col(f"`{column}`"))}).select(*df.columns)


def truncate_texts(df: DataFrame, columns: list[str], scope: Scope) -> DataFrame:
    """Keep 1 to length-1 characters."""
    out = {}
    for c in columns:
        s = F.col(f"`{c}`")
        n = F.char_length(s)
        out[c] = F.when(scope.hit(df, "truncate", c) & (n >= 2), F.left(s, scope.rng(df, "truncate").integer(1, n - 1, c, "keep").cast("int"))).otherwise(s)
    return _replace(df, out)


def violate_keys(df: DataFrame, columns: list[str], scope: Scope) -> DataFrame:
    """References to records that do not exist: beyond the greatest key for numbers, a marked text for texts."""
    numbers = [c for c in columns if not isinstance(df.schema[c].dataType, T.StringType)]
    wide = df.join(F.broadcast(df.agg(*[F.max(f"`{c}`").alias(f"__m{i}") for i, c in enumerate(numbers)], F.lit(1).alias("__one"))))
    out = {}
    for c in columns:
        rng = scope.rng(df, "fk_violate")
        bad = F.col(f"__m{numbers.index(c)}") + rng.integer(1, 1_000_000, c, "far") if c in numbers else F.concat(F.lit("absent-"), rng.bits(c, "text").cast("string"))
        out[c] = F.when(scope.hit(df, "fk_violate", c), bad).otherwise(F.col(f"`{c}`"))
    return _replace(wide, out).select(*df.columns)


def spike_times(df: DataFrame, column: str, scope: Scope, spikes: int = 3, sigma_s: float = 60.0) -> DataFrame:
    """Chosen times gather around a few centres within the column's span."""
    t = F.unix_millis(F.col(f"`{column}`").cast("timestamp"))
    wide = df.join(F.broadcast(df.agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))))
    rng = scope.rng(df, "temporal_spike")
    place = Rng(scope.seed, "temporal_spike_centre", rng.integer(1, spikes, column, "which").cast("string"), scope.portable).uniform(column)
    at = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * place + rng.normal(column) * sigma_s * 1000
    return _replace(wide, {column: F.when(scope.hit(df, "temporal_spike", column), F.timestamp_millis(at.cast("long"))).otherwise(F.col(f"`{column}`").cast("timestamp"))}).select(*df.columns)


@dataclass
class Pipeline:
    """Perturbators run in order of stage; each step is (name, keyword arguments) and gets its own seed."""

    key: str
    seed: int = 0
    steps: list[tuple[str, dict]] = field(default_factory=list)
    portable: bool = False

    def add(self, name: str, **options) -> Pipeline:
        if name not in STAGES:
            raise ValueError(f"unknown perturbator {name}")
        self.steps.append((name, options))
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        order = ["clean", "constrained", "breaking"]
        # predicates read the original rows, so they are kept as columns until all steps are done
        names = df.columns
        steps = sorted(enumerate(self.steps), key=lambda x: (order.index(STAGES[x[1][0]]), x[0]))
        masks = {i: F.coalesce(compile_expression(o["where"], df.schema), F.lit(False)).alias(f"__mask{i}") for i, (_, o) in steps if o.get("where")}
        df = df.select("*", *masks.values())
        for i, (name, options) in steps:
            o = dict(options)
            where = o.pop("where", None)
            scope = Scope(self.key, o.pop("rate", 0.1), self.seed ^ (i * 0x9E3779B9), f"${{__mask{i}}}" if where else None, self.portable)
            df = APPLY[name](df, scope, **o)
        return df.select(*[f"`{c}`" for c in names])


APPLY = {
    "null": lambda d, s, columns: inject_nulls(d, columns, s),
    "gaussian": lambda d, s, columns, **o: add_gaussian(d, columns, s, **o),
    "typo": lambda d, s, columns: inject_typos(d, columns, s),
    "outlier": lambda d, s, columns, **o: inject_outliers(d, columns, s, **o),
    "duplicate": lambda d, s: append_duplicates(d, s),
    "drift": lambda d, s, columns, **o: drift_values(d, columns, s, **o),
    "format": lambda d, s, columns: corrupt_formats(d, columns, s),
    "swap": lambda d, s, column: swap_values(d, column, s),
    "truncate": lambda d, s, columns: truncate_texts(d, columns, s),
    "fk_violate": lambda d, s, columns: violate_keys(d, columns, s),
    "temporal_spike": lambda d, s, column, **o: spike_times(d, column, s, **o),
}
