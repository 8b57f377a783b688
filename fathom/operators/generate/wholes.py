"""Generators that need more than a row: keys of parents that follow no rule, lookups, actors, graphs, threads and series.

Each takes the table as far as it is built, with its ``__row`` numbers, and returns it with one more column. Both sides of every join are keyed by
dense row numbers or by values; a side is broadcast only where its size is known to be small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.rng import Rng
from fathom.operators.generate import graphs, series
from fathom.operators.generate.columns import Context, Keys, make, weighted_pick
from fathom.operators.generate.distributions import distribution
from fathom.operators.relational import BROADCAST_ROWS, prefix_sums, row_index, small


@dataclass
class Build:
    """A table in the making: ``keys`` of all tables, and ``table`` to make another one with its row numbers."""

    spark: SparkSession
    model: dict
    name: str
    keys: dict[str, Keys]
    table: Callable[[str], DataFrame]
    portable: bool = False

    @property
    def rows(self) -> int:
        return self.model["tables"][self.name]["count"]

    def rng(self, row: Column | None = None, name: str | None = None) -> Rng:
        return Rng(self.model.get("seed", 0), name or self.name, F.col("__row") if row is None else row, self.portable)

    def rows_of(self, parent: str, *extra: str) -> DataFrame:
        """(__at, __key, ...) of a parent: the number and the key of each row."""
        fields = self.model["tables"][parent]["fields"]
        pk = next((f for f, s in fields.items() if s.get("primary_key")), None)
        if pk is None and not extra:
            return self.spark.range(self.keys[parent].rows).select(F.col("id").alias("__at"), self.keys[parent].at(F.col("id")).alias("__key"))
        t = self.table(parent)
        key = F.col(f"`{pk}`") if pk else self.keys[parent].at(F.col("__row"))
        return t.select(F.col("__row").alias("__at"), key.alias("__key"), *extra)

    def beside(self, parent: str, side: DataFrame) -> DataFrame:
        """A side with one row per row of a parent, whose number the model states."""
        return F.broadcast(side) if self.model["tables"][parent]["count"] <= BROADCAST_ROWS else side

    def key_at(self, df: DataFrame, index: str, parent: str, name: str) -> DataFrame:
        """Column ``name``: the parent's key at the row numbers in ``index``; null for null."""
        keys = self.keys[parent]
        if not keys.joined:
            return df.withColumn(name, F.when(F.col(index).isNotNull(), keys.at(F.col(index))))
        side = self.rows_of(parent).select(F.col("__at").alias("__k_at"), F.col("__key").alias(name))
        return df.join(self.beside(parent, side), F.col(index) == F.col("__k_at"), "left").drop("__k_at")

    def row_at(self, df: DataFrame, key: str, parent: str, name: str) -> DataFrame:
        """Column ``name``: the row number of the parent that a key names."""
        keys = self.keys[parent]
        if keys.plain:
            return df.withColumn(name, ((F.col(f"`{key}`") - keys.start) / keys.step).cast("long"))
        side = self.rows_of(parent).select(F.col("__at").alias(name), F.col("__key").alias("__r_key"))
        return df.join(self.beside(parent, side), F.col(f"`{key}`") == F.col("__r_key"), "left").drop("__r_key")


Whole = Callable[..., DataFrame]
WHOLES: dict[str, Whole] = {}


def whole(name: str) -> Callable[[Whole], Whole]:
    def register(f: Whole) -> Whole:
        WHOLES[name] = f
        return f

    return register


# --- references


@whole("fk")
def fk(b: Build, df: DataFrame, name: str, parent: str, weight_field: str | None = None, **options) -> DataFrame:
    """A key of any parent, drawn as by the columnar generator; with ``weight_field`` in proportion to a number of the parent."""
    if weight_field:
        return _weighted(b, df, name, b.rows_of(parent, weight_field), weight_field)
    plain = Context(b.model.get("seed", 0), b.name, name, b.rows, portable=b.portable, parents={parent: Keys(b.keys[parent].rows, 0)})
    return b.key_at(df.withColumn("__fk", make(plain, {"type": "fk", "parent": parent, **options})), "__fk", parent, name).drop("__fk")


def _weighted(b: Build, df: DataFrame, name: str, parents: DataFrame, weight: str) -> DataFrame:
    drawn = weighted_pick(df.withColumn("__u", b.rng().uniform(name, "pick")), "__u", parents.select("__at", weight), "__at", weight, "__picked").drop("__u")
    side = parents.select(F.col("__at").alias("__picked"), F.col("__key").alias(name))
    return drawn.join(side, "__picked").drop("__picked")


@whole("actor_ref")
def actor_ref(b: Build, df: DataFrame, name: str, actor: str, activity: dict | None = None) -> DataFrame:
    """A key of an actor table, in proportion to how active each actor is, which a distribution over its rows says."""
    activity = activity or {"family": "log_normal"}
    weight = distribution(b.rng(F.col("__at"), actor), activity.get("family", "log_normal"), activity.get("params", {}), "activity")
    return _weighted(b, df, name, b.rows_of(actor).withColumn("__activity", weight), "__activity")


@whole("relationship_ref")
def relationship_ref(b: Build, df: DataFrame, name: str, actor_field: str, graph: str) -> DataFrame:
    """A neighbour of another field's actor in one of the model's graphs; null where it has none."""
    spec = b.model["graphs"][graph]
    at = b.row_at(df, actor_field, spec["actor"], "__src")
    linked = graphs.neighbour_of(at, b.rng(), "__src", edges_of(b, graph), "__dst")
    return b.key_at(linked, "__dst", spec["actor"], name).drop("__src", "__dst")


def edges_of(b: Build, graph: str) -> DataFrame:
    """(src, dst) row numbers of a graph of the model, by its kind and that kind's parameters."""
    spec = dict(b.model["graphs"][graph])
    kind, actor, back = spec.pop("kind"), spec.pop("actor"), spec.pop("reciprocity", 0.0)
    n, seed = b.model["tables"][actor]["count"], b.model.get("seed", 0)
    kinds = {"small_world": graphs.small_world, "scale_free": graphs.scale_free, "erdos_renyi": graphs.erdos_renyi, "blocks": graphs.blocks, "configuration": graphs.configuration, "hierarchical": graphs.lateral_hierarchy}
    if kind == "custom":
        made = b.spark.createDataFrame([tuple(e) for e in spec["edges"]], "src long, dst long")
    elif kind == "complete":
        made = graphs.complete(b.spark, n)
    elif kind == "tree":
        made = graphs.tree(b.spark, n, **spec).where("parent is not null").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    else:
        made = kinds[kind](b.spark, n, seed=seed, **spec)
    return graphs.reciprocated(made, back, seed) if back else made


@whole("thread_ref")
def thread_ref(b: Build, df: DataFrame, name: str, reply: float = 0.5, window: int = 20, max_depth: int = 5) -> DataFrame:
    """The key of an earlier row of the same table that this one replies to; chains are no deeper than ``max_depth``."""
    made = graphs.threads(df.select("__row"), b.rng(), F.col("__row"), reply, window, "__to")
    capped = graphs.cap_depth(made, "__row", "__to", max_depth)
    return b.key_at(df.join(capped, "__row"), "__to", b.name, name).drop("__to")


# --- lookups


def _numbered(b: Build, df: DataFrame) -> DataFrame:
    return row_index(df, df.columns, "__at")


def _picked(b: Build, df: DataFrame, side: DataFrame, n: int, path: tuple, mode: str = "uniform", weight: str | None = None) -> DataFrame:
    """Columns of one row of ``side`` (numbered by __at) for each row."""
    if weight:
        drawn = weighted_pick(df.withColumn("__u", b.rng().uniform(*path)), "__u", side.select("__at", F.col(weight).alias("__weight")), "__at", "__weight", "__pick").drop("__u")
    else:
        drawn = df.withColumn("__pick", F.col("__row") % n if mode == "sequential" else b.rng().integer(0, n - 1, *path))
    return drawn.join(small(side.withColumnRenamed("__at", "__pick")), "__pick").drop("__pick")


def _fields_of(b: Build, kind: str, option: str, value: str) -> dict[str, str]:
    """Fields of the table that read columns of the same source, and which."""
    fields = b.model["tables"][b.name]["fields"]
    return {f: s["generator"]["column"] for f, s in fields.items() if s.get("generator", {}).get("type") == kind and s["generator"].get(option) == value}


@whole("tuple_lookup")
def tuple_lookup(b: Build, df: DataFrame, name: str, tuple: str, column: str) -> DataFrame:  # noqa: A002
    """A column of a tuple of the model; all fields of a row that name the tuple come from one and the same of its rows."""
    if name in df.columns:
        return df
    spec = b.model["tuples"][tuple]
    wanted = _fields_of(b, "tuple_lookup", "tuple", tuple)
    weights = spec.get("weights")
    rows = [(i, float(weights[i]) if weights else 1.0, *r) for i, r in enumerate(spec["rows"])]
    side = b.spark.createDataFrame(rows, ["__at", "__tuple_weight", *spec["columns"]])
    side = side.select("__at", "__tuple_weight", *[F.col(f"`{c}`").alias(f) for f, c in wanted.items()])
    return _picked(b, df, side, len(rows), ("tuple", tuple), weight="__tuple_weight" if weights else None).drop("__tuple_weight")


@whole("row_lookup")
def row_lookup(b: Build, df: DataFrame, name: str, path: str, column: str) -> DataFrame:
    """A column of a file; all fields of a row that name the file come from one of its rows."""
    from fathom.sources.readers import read

    if name in df.columns:
        return df
    wanted = _fields_of(b, "row_lookup", "path", path)
    side = _numbered(b, read(b.spark, path)).select("__at", *[F.col(f"`{c}`").alias(f) for f, c in wanted.items()])
    return _picked(b, df, side, side.count(), ("rows", path))


@whole("external_lookup")
def external_lookup(b: Build, df: DataFrame, name: str, path: str, column: str, mode: str = "uniform", weight: str | None = None) -> DataFrame:
    """A value of a file's column: drawn uniformly, by a column of weights, or each in turn in ascending order."""
    from fathom.sources.readers import read

    source = read(b.spark, path).where(F.col(f"`{column}`").isNotNull())
    side = row_index(source, [column, *[c for c in source.columns if c != column]], "__at")
    side = side.select("__at", F.col(f"`{column}`").alias(name), *([F.col(f"`{weight}`").cast("double").alias("__lookup_weight")] if weight else []))
    return _picked(b, df, side, side.count(), (name, "lookup"), mode, "__lookup_weight" if weight else None).drop("__lookup_weight")


# --- values


@whole("unique")
def unique(b: Build, df: DataFrame, name: str, of: dict, separator: str = "-") -> DataFrame:
    """Any generator's values made different as texts: a repeated one has its number behind it. The number goes by row, and a value that many rows
    have is spread over tasks."""
    inner = Context(b.model.get("seed", 0), b.name, name, b.rows, portable=b.portable, schema=df.schema, parents=b.keys, model=b.model)
    made = df.withColumn("__v", make(inner, of).cast("string"))
    nth = prefix_sums(made, ["__row"], F.lit(1).cast("long"), ["__v"], "__n")
    return nth.withColumn(name, F.when(F.col("__n") == 1, F.col("__v")).otherwise(F.concat_ws(separator, "__v", F.col("__n").cast("string")))).drop("__v", "__n")


@whole("correlated")
def correlated(b: Build, df: DataFrame, name: str, source: str, r: float = 0.5, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    return series.correlated(df, Rng(b.model.get("seed", 0), f"{b.name}.{name}", F.col("__row"), b.portable), source, r, mean, std, name)


@whole("numeric_time_series")
def numeric_time_series(
    b: Build, df: DataFrame, name: str, series: str | None = None, time: str | None = None, start: float = 0.0, slope: float = 0.0, curve: float = 0.0, seasons: list[dict] = (), noise: float = 0.0, ar: list[float] = (), reversion: float = 0.0,
    spike_p: float = 0.0, spike_size: float = 0.0, spike_decay: float = 0.5, shift_p: float = 0.0, shift_size: float = 0.0, calendar: dict | None = None,
) -> DataFrame:
    """Trend, seasons, level shifts, noise or a recurrence, and calendar factors of the ``time`` field; one series, or one for each value of ``series``."""
    from fathom.operators.generate import series as parts

    rng = Rng(b.model.get("seed", 0), f"{b.name}.{name}", F.col("__row"), b.portable)
    key = "__series"
    out = df.withColumn(key, F.col(f"`{series}`").cast("string") if series else F.lit("one"))
    out = prefix_sums(out, ["__row"], F.lit(1).cast("long"), [key], "__step").withColumn("__step", F.col("__step") - 1)
    value = parts.trend(F.col("__step"), start, slope, curve)
    for s in seasons:
        value = value + parts.seasonality(F.col("__step"), s["period"], s["amplitude"], s.get("phase", 0.0))
    if shift_p:
        out = parts.level_shift(out, rng, key, "__step", shift_p, shift_size, "__level")
        value = value + F.col("__level")
    if ar or reversion or spike_p:
        out = parts.recurrence(out, rng, key, "__step", "__x", ar=list(ar), reversion=reversion, sigma=noise, spike_p=spike_p, spike_size=spike_size, spike_decay=spike_decay)
        value = value + F.col("__x")
    elif noise:
        value = value + rng.normal("noise") * noise
    if time and calendar:
        value = value * parts.calendar(F.col(f"`{time}`"), **calendar)
    return out.withColumn(name, value).drop(key, "__step", "__level", "__x")


@whole("event_stream")
def event_stream(b: Build, df: DataFrame, name: str, rate_per_s: float, series: str | None = None, start: str = "2024-01-01", profile: list[float] | None = None) -> DataFrame:
    """Times with exponential gaps, one stream for each value of ``series``. With 24 hourly factors the clock runs through the day as they say, so that
    every row keeps its event."""
    rng = Rng(b.model.get("seed", 0), f"{b.name}.{name}", F.col("__row"), b.portable)
    keyed = df.withColumn("__series", F.col(f"`{series}`").cast("string") if series else F.lit("one"))
    gap = -F.ln(F.lit(1.0) - rng.uniform("gap"))
    at = prefix_sums(keyed, ["__row"], gap, ["__series"], "__s")
    seconds = F.col("__s") / rate_per_s if not profile else _clock(F.col("__s"), [rate_per_s * p for p in profile])
    return at.withColumn(name, F.timestamp_millis(F.unix_millis(F.lit(start).cast("timestamp")) + (seconds * 1000).cast("long"))).drop("__s", "__series")


def _clock(units: Column, rates: list[float]) -> Column:
    """The second at which a process of hourly rates per second has had so many expected events."""
    per_day = sum(rates) * 3600
    day = F.floor(units / per_day)
    rest, out, at = units - day * per_day, None, 0.0
    for h, r in enumerate(rates):
        if r > 0:
            inside = F.lit(h * 3600.0) + (rest - at) / r
            out = F.when(rest < at + r * 3600, inside) if out is None else out.when(rest < at + r * 3600, inside)
            at += r * 3600
    return day * 86_400.0 + F.coalesce(out, F.lit(86_399.0))


@whole("actor_bursts")
def actor_bursts(b: Build, df: DataFrame, name: str, actor_field: str, size: float = 5.0, gap_s: float = 30.0, idle_s: float = 7200.0, start: str = "2024-01-01") -> DataFrame:
    rng = Rng(b.model.get("seed", 0), f"{b.name}.{name}", F.col("__row"), b.portable)
    return series.bursts(df, rng, actor_field, "__row", size, gap_s, idle_s, start, name)


def gaussian_copulas(b: Build, df: DataFrame) -> DataFrame:
    """The table's columns reordered to the rank correlations its ``copulas`` state."""
    for i, c in enumerate(b.model["tables"][b.name].get("copulas", [])):
        made = series.gaussian_copula(df.select("__row", *c["columns"]), Rng(b.model.get("seed", 0), f"{b.name}.copula{i}", F.col("__row"), b.portable), "__row", c["columns"], c["matrix"])
        df = df.drop(*c["columns"]).join(made, "__row").select(*df.columns)
    return df


def edge_rows(b: Build) -> DataFrame | None:
    """(__row, __src, __dst): the rows of a table that a graph makes: its edges, or with ``mean`` a Poisson number of events for each."""
    spec = b.model["tables"][b.name].get("edges")
    if not spec:
        return None
    made = edges_of(b, spec["graph"])
    order = ["src", "dst"]
    if "mean" in spec:
        made, order = graphs.interactions(made, spec["mean"], b.model.get("seed", 0)), ["src", "dst", "seq"]
    return row_index(made, order, "__row").select("__row", F.col("src").alias("__src"), F.col("dst").alias("__dst"))


@whole("edge_end")
def edge_end(b: Build, df: DataFrame, name: str, side: str = "source") -> DataFrame:
    """The key at one end of the row's edge."""
    graph = b.model["graphs"][b.model["tables"][b.name]["edges"]["graph"]]
    return b.key_at(df, "__src" if side == "source" else "__dst", graph["actor"], name)
