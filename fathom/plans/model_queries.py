"""Queries of generation, noise, pseudonyms, scaling, checks and scores, with their SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.rng import Rng, integer_sql, uniform_sql
from fathom.operators import check, enrich, noise, pseudonymize, scale
from fathom.operators.generate import columns, engine, graphs, series
from fathom.sources import readers, sinks
from fathom.sources.tables import table

MODEL = {
    "seed": 42,
    "tables": {
        "shop": {"count": 500, "fields": {"id": {"type": "int", "primary_key": True, "generator": {"type": "sequence", "start": 100, "step": 2}}, "code": {"type": "string", "generator": {"type": "pattern", "pattern": "AA-##?"}}, "uid": {"type": "uuid", "generator": {"type": "uuid"}}, "tier": {"type": "string", "generator": {"type": "one_of", "values": ["gold", "silver", "bronze"], "weights": [1, 3, 6]}}, "slot": {"type": "string", "generator": {"type": "cyclic", "values": ["a", "b", "c"]}}}},
        "sale": {"count": 20_000, "fields": {"id": {"type": "int", "primary_key": True, "generator": {"type": "sequence"}}, "shop_id": {"type": "int", "generator": {"type": "fk", "parent": "shop"}}, "turn": {"type": "int", "generator": {"type": "fk", "parent": "shop", "selection": "sequential"}}, "quantity": {"type": "int", "generator": {"type": "distribution", "family": "uniform", "params": {"min": 1, "max": 9}, "round": True}}, "price": {"type": "float", "precision": 2, "generator": {"type": "distribution", "family": "uniform", "params": {"min": 5.0, "max": 200.0}}, "null": 0.1}, "total": {"type": "float", "generator": {"type": "derived", "expression": "round(${quantity} * ${price}, 2)"}}, "size": {"type": "string", "generator": {"type": "derived", "expression": 'if(${quantity} > 5, "big", "small")'}}}},
    },
    "relationships": [{"name": "sale_shop", "from_table": "sale", "foreign_key": "shop_id", "to_table": "shop", "to_column": "id"}],
}


def gen_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.generate_table(spark, MODEL, "shop", portable=True)


def gen_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine.generate_table(spark, MODEL, "sale", portable=True)
    return out.withColumns({"price": F.round("price", 2), "total": F.round("total", 2)})


def _drawn(spark: SparkSession, rows: int, names: dict[str, dict]) -> DataFrame:
    ctx = {n: columns.Context(7, "draws", n, rows, portable=True) for n in names}
    return engine.row_source(spark, rows).select(F.col("__row").alias("row"), *[columns.make(ctx[n], spec).alias(n) for n, spec in names.items()])


CLOSED = {"uniform": {"min": 2.0, "max": 5.0}, "exponential": {"lambda": 0.5}, "pareto": {"scale": 2.0, "shape": 3.0}, "weibull": {"scale": 2.0, "shape": 1.5}, "bernoulli": {"p": 0.3}, "geometric": {"p": 0.25}, "triangular": {"min": 0.0, "max": 10.0, "mode": 3.0}, "normal": {"mean": 10.0, "std_dev": 2.0}, "log_normal": {"mu": 1.0, "sigma": 0.5}, "cauchy": {"median": 1.0, "scale": 2.0}}
OPEN = {"poisson": {"lambda": 4.0}, "binomial": {"n": 20, "p": 0.3}, "zipf": {"n": 50, "s": 1.2}, "gamma": {"shape": 2.5, "scale": 2.0}, "beta": {"alpha": 2.0, "beta": 5.0}, "chi_squared": {"k": 4.0}, "student_t": {"n": 6.0}}


def gen_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with a closed inverse, on 5 000 rows."""
    out = _drawn(spark, 5000, {f: {"type": "distribution", "family": f, "params": p} for f, p in CLOSED.items()})
    return out.select("row", *[F.round(f, 6).alias(f) for f in CLOSED])


def gen_distribution_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations of the families that need a table or rejection, on 100 000 rows."""
    out = _drawn(spark, 100_000, {f: {"type": "distribution", "family": f, "params": p} for f, p in OPEN.items()})
    cells = F.array(*[F.struct(F.lit(f).alias("family"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")) for f in OPEN])
    return out.agg(cells.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def gen_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, 1000, {"shares": {"type": "distribution", "family": "dirichlet", "params": {"alpha": [1.0, 2.0, 3.0]}}, "counts": {"type": "distribution", "family": "multinomial", "params": {"n": 10, "weights": [1.0, 1.0, 2.0]}}})


def gen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of generated text, 200 rows of each."""
    out = None
    for k in columns.FAKES:
        ctx = columns.Context(7, "texts", k, 200)
        part = engine.row_source(spark, 200).select(F.lit(k).alias("kind"), F.col("__row").alias("row"), columns.faker(ctx, k).cast("string").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def gen_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = columns.Context(7, "cond", "note", 3000, portable=True)
    base = engine.row_source(spark, 3000).withColumn("kind", columns.cyclic(ctx, ["x", "y", "z"]))
    note = columns.conditional(ctx, "kind", {"x": {"type": "constant", "value": "first"}, "y": {"type": "constant", "value": "second"}}, {"type": "constant", "value": "other"})
    return base.select(F.col("__row").alias("row"), "kind", note.alias("note"))


def gen_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drawn(spark, 500, {"tags": {"type": "composite", "element": {"type": "one_of", "values": ["a", "b"]}, "max_length": 4}, "place": {"type": "struct", "fields": {"city": {"type": "faker", "kind": "city"}, "zip": {"type": "faker", "kind": "zip"}}}})
    return out.select("row", "tags", F.to_json("place").alias("place"))


def gen_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, 50_000, {"id": {"type": "unique_int", "low": 1, "high": 60_000}})


def gen_weighted_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders drawn for customers in proportion to their balance."""
    rows = engine.row_source(spark, 20_000).withColumn("u", Rng(5, "wp", F.col("__row"), portable=True).uniform("pick"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return columns.weighted_pick(rows, "u", c, "c_custkey", "c_acctbal", "c_custkey").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


def gen_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, season and calendar of an hourly series of 90 days."""
    t = F.timestamp_seconds(F.lit(1704067200) + F.col("__row") * 3600)
    step = F.col("__row")
    value = (series.trend(step, 10, 0.01) + series.seasonality(step, 24, 3)) * series.calendar(t, weekend=0.5, business=1.5)
    return engine.row_source(spark, 2160).select(F.col("__row").alias("row"), F.round(value, 6).alias("value"))


def gen_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine.row_source(spark, 5000).withColumns({"series": F.col("__row") % 10, "step": F.floor(F.col("__row") / 10)})
    rng = Rng(3, "rec", F.col("__row"))
    shifted = series.level_shift(rows, rng, "series", "step", 0.01, 5.0)
    return series.recurrence(shifted, rng, "series", "step", ar=[0.8], spike_p=0.01, spike_size=9.0).select("series", "step", "level", "value")


def gen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine.row_source(spark, 20_000).withColumns({"series": F.col("__row") % 20, "step": F.floor(F.col("__row") / 20)})
    profile = [0.2] * 8 + [1.0] * 10 + [0.5] * 6
    return series.event_stream(rows, Rng(3, "ev", F.col("__row")), "series", "step", 1 / 60.0, profile=profile).select("series", "step", "ts")


def gen_copulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dependent uniforms of each closed copula."""
    rng = Rng(9, "cop", F.col("__row"), portable=True)
    u, t = rng.uniform("u"), rng.uniform("t")
    return engine.row_source(spark, 5000).select(F.col("__row").alias("row"), F.round(u, 6).alias("u"), F.round(series.clayton(F.greatest(u, F.lit(1e-9)), F.greatest(t, F.lit(1e-9)), 2.0), 6).alias("clayton"), F.round(series.frank(u, t, 5.0), 6).alias("frank"))


def gen_gaussian_copula(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    out = series.gaussian_copula(p, Rng(4, "gc", F.col("c_custkey")), "c_custkey", ["c_acctbal", "nation"], [[1.0, 0.8], [0.8, 1.0]])
    return out.select("c_custkey", "c_acctbal", "nation")


def gen_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.tree(spark, 5000, 3)


def gen_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.random_tree(spark, 5000, 11, max_depth=4)


def gen_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and mean out-degree of every kind of graph."""
    made = {"complete": graphs.complete(spark, 60), "erdos_renyi": graphs.erdos_renyi(spark, 2000, 0.002, 1), "small_world": graphs.small_world(spark, 2000, 4, 0.3, 1), "scale_free": graphs.scale_free(spark, 2000, 2, 1), "blocks": graphs.blocks(spark, 900, 3, 0.01, 0.002, 1), "configuration": graphs.configuration(spark, 2000, 4.0, 1), "hierarchical": graphs.lateral_hierarchy(spark, 2000, 4, 1), "reciprocated": graphs.reciprocated(graphs.small_world(spark, 2000, 4, 0.3, 1), 0.5, 1)}
    out = None
    for k, e in made.items():
        s = e.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"))
        out = s if out is None else out.unionByName(s)
    return out


def gen_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine.row_source(spark, 3000)
    made = graphs.threads(rows, Rng(2, "th", F.col("__row")), F.col("__row"), 0.6, 20)
    return graphs.cap_depth(made, "__row", "reply_to", 5).select(F.col("__row").alias("row"), "reply_to")


# --- noise

_SCOPE = noise.Scope("o_orderkey", 0.2, seed=5, portable=True)


def noise_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls in a fifth of the orders over 100 000."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return noise.inject_nulls(o, ["o_orderpriority"], noise.Scope("o_orderkey", 0.2, 5, "${o_totalprice} > 100000", True))


def noise_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.inject_typos(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], _SCOPE)


def noise_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.inject_outliers(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], _SCOPE, 3.0).withColumn("o_totalprice", F.round("o_totalprice", 4))


def noise_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.append_duplicates(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), _SCOPE)


def noise_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.drift_values(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], _SCOPE, 0.5).withColumn("o_totalprice", F.round("o_totalprice", 4))


def noise_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return noise.corrupt_formats(o, ["o_orderpriority", "day"], _SCOPE)


def noise_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.swap_values(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", _SCOPE)


def noise_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.truncate_texts(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], _SCOPE)


def noise_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.violate_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], _SCOPE)


def noise_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.spike_times(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", _SCOPE)


def noise_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.add_gaussian(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], _SCOPE, 0.1, relative=True).withColumn("o_totalprice", F.round("o_totalprice", 3))


def noise_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    p = noise.Pipeline("o_orderkey", 9).add("duplicate", rate=0.05).add("null", rate=0.1, columns=["o_orderpriority"], where="${o_totalprice} > 50000").add("typo", rate=0.1, columns=["o_orderpriority"]).add("gaussian", rate=0.3, columns=["o_totalprice"], sigma=10.0)
    return p.apply(o)


# --- pseudonyms


def token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of all names of customers and suppliers."""
    frames = [(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"]), (table(spark, sf_dir, "supplier"), ["s_name"])]
    m = pseudonymize.build_map(pseudonymize.distinct_values(frames), 17)
    return m.select("value", pseudonymize.shape(F.col("token")).alias("shape"))


def token_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with tokens, dates of orders shifted, and everything restored."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    m = pseudonymize.build_map(pseudonymize.distinct_values([(c, ["c_name", "c_mktsegment"])]), 17)
    there = pseudonymize.apply_map(c, ["c_name", "c_mktsegment"], m)
    return pseudonymize.restore_map(there, ["c_name", "c_mktsegment"], m)


def token_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), "o_custkey")
    days, by = pseudonymize.day_shift(17), pseudonymize.number_shift(17)
    out = pseudonymize.shift_numbers(pseudonymize.shift_text_dates(pseudonymize.shift_dates(o, ["o_orderdate"], days), ["day"], days), ["o_custkey"], by)
    return out.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def token_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    m = pseudonymize.build_map(pseudonymize.distinct_values([(c, ["c_name"])]), 17)
    return pseudonymize.verify(c, pseudonymize.apply_map(c, ["c_name"], m), ["c_name"])


def token_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and tokens of small and large shapes: all single capitals, all pairs of a letter and a digit, nations and customers."""
    letters = spark.range(26).select(F.char(F.col("id") + 65).alias("v"))
    pairs = spark.range(260).select(F.concat(F.char(F.floor(F.col("id") / 10) + 97), (F.col("id") % 10).cast("string")).alias("v"))
    frames = [(letters, ["v"]), (pairs, ["v"]), (table(spark, sf_dir, "nation"), ["n_name"]), (table(spark, sf_dir, "customer"), ["c_name"])]
    return pseudonymize.report(pseudonymize.build_map(pseudonymize.distinct_values(frames), 17))


# --- checks and scores

_CHECKED = {"tables": {"orders": {"rows": (1, 10**12), "fields": {"o_orderkey": {"type": "int", "primary_key": True}, "o_custkey": {"type": "string"}, "o_missing": {"type": "int"}, "o_orderstatus": {"type": "string", "nullable": False}}}, "requests": {"fields": {"id": {"type": "int", "primary_key": True}, "method": {"type": "string", "nullable": False}}}}, "relationships": [{"from_table": "requests", "foreign_key": "server_id", "to_table": "servers", "to_column": "id"}]}


def check_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.validate({n: table(spark, sf_dir, n) for n in ("orders", "requests", "servers")}, _CHECKED).where("finding <> 'extra_column'").select("table_name", "column_name", "finding", "severity", "n")


def check_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", F.col("l_linenumber").cast("double").alias("low"), F.col("l_quantity").alias("high"))
    return engine.enforce(engine.enforce(li, {"range": ["l_quantity", 10.0, 40.0]}), {"ordered": ["low", "high"]})


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'")


def score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return check.compare_columns(a, b, ["l_quantity", "l_discount"], ["l_returnflag"]).withColumn("score", F.round("score", 6))


def score_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return check.range_overlap(a, b, "l_extendedprice").select(F.round("score", 6).alias("score"))


def score_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return check.correlation_kept(a, b, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select(F.round("score", 6).alias("score"))


def score_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.fk_integrity(table(spark, sf_dir, "requests"), "customer_id", table(spark, sf_dir, "customers"), "CustomerId").select(F.round("score", 9).alias("score"))


def score_fk_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References none of which exists."""
    lost = table(spark, sf_dir, "orders").select((-F.col("o_custkey")).alias("c"))
    return check.fk_integrity(lost, "c", table(spark, sf_dir, "customer").where("c_custkey > 0"), "c_custkey")


def score_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customers")
    return check.lengths(c.where("Country = 'Jeinia'"), c.where("Country <> 'Jeinia'"), "LastName").select(F.round("score", 6).alias("score"))


# --- scaling, enrichment, sinks


def scale_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("region", "nation", "customer", "orders")
    return scale.dimensions({n: table(spark, sf_dir, n) for n in names}, ["customer"], [("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("orders", "o_custkey", "customer")])


def scale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = None
    for n in ("nation", "customer", "orders", "events"):
        c = table(spark, sf_dir, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        counts = c if counts is None else counts.unionByName(c)
    return scale.planned_rows(counts, scale.Plan(actors={"customer": 2.5}, time={"events": 3.0}, density=1.2), {"orders": "customer"})


def scale_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.cadence(table(spark, sf_dir, "orders"), "o_orderdate")


def scale_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.row_bytes(table(spark, sf_dir, "customer")).select("rows", F.round("bytes_per_row", 6).alias("bytes_per_row"), F.round("bytes", 3).alias("bytes"))


def enrich_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.mapping_scores(spark, [("qty", "double"), ("cust_name", "string")], [("quantity", "int"), ("customerName", "string"), ("address", "string")]).select("left", "right", *[F.round(c, 6).alias(c) for c in ("name_score", "type_score", "score")])


def sink_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rendered(table(spark, sf_dir, "nation"), "{n_nationkey|pad_left:4}: {n_name|lower}")


def sink_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as INSERT statements."""
    return sinks.sql_inserts(table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1), "nation", rows_per_insert=100)


def sink_csv_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x * 100).cast("int")).alias("scaled"))
    return sinks.flattened(e)


def scan_companion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.apply_companion(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), {"dictionaries": {"o_orderstatus": {"F": "finished", "O": "open"}}, "types": {"o_orderkey": "string"}})


QUERIES = {k: v for k, v in list(globals().items()) if k.split("_")[0] in ("gen", "noise", "token", "check", "score", "scale", "enrich", "sink", "scan") and callable(v)}

_u = lambda e, row, *p: uniform_sql(7 if e == "draws" else 42, e, row, *p)
_hit = lambda name, col: f"{uniform_sql(5, name, 'o_orderkey', col, 'hit')} < 0.2"


def _pattern_sql() -> str:
    draw = f"floor({uniform_sql(42, 'shop', 'r', 'code', 0)} * {float(1 << 50)!r}"
    digit = lambda below, n: f"cast({draw} / {below}) as bigint) % {n}"
    return f"chr(cast({digit(1, 26)} + 65 as int)) || chr(cast({digit(26, 26)} + 65 as int)) || '-' || lpad(cast({digit(676, 100)} as varchar), 2, '0') || chr(cast({digit(67600, 26)} + 97 as int))"


_UUID = "md5('42|shop|uid|' || cast(r as varchar))"
_WEIGHTED = uniform_sql(42, "shop", "r", "tier")
_CLOSED_SQL = {
    "uniform": "2.0 + U * 3.0",
    "exponential": "-ln(1 - U) / 0.5",
    "pareto": f"2.0 / pow(1 - U, {1 / 3!r})",
    "weibull": f"2.0 * pow(-ln(1 - U), {1 / 1.5!r})",
    "bernoulli": "cast(U < 0.3 as int)::double",
    "geometric": "floor(ln(1 - U) / ln(0.75))",
    "triangular": "case when U < 0.3 then sqrt(U * 30) else 10 - sqrt((1 - U) * 70) end",
    "normal": "sqrt(-2 * ln(1 - R)) * cos(2 * pi() * A) * 2.0 + 10.0",
    "log_normal": "exp(sqrt(-2 * ln(1 - R)) * cos(2 * pi() * A) * 0.5 + 1.0)",
    "cauchy": "1.0 + 2.0 * tan(pi() * (U - 0.5))",
}


def _closed_sql() -> str:
    made = []
    for f, e in _CLOSED_SQL.items():
        for mark, path in (("U", (f, f)), ("R", (f, f, "r")), ("A", (f, f, "a"))):
            e = re.sub(rf"\b{mark}\b", lambda _: _u("draws", "r", *path), e)  # noqa: B023
        made.append(f"round({e}, 6) as {f}")
    return f"select r as row, {', '.join(made)} from range(5000) t(r)"


_TYPO_AT = integer_sql(1, "length(o_orderpriority) - 1", 5, "typo", "o_orderkey", "o_orderpriority", "at")
_LETTER = f"substr('{noise.LETTERS}', {integer_sql(1, 26, 5, 'typo', 'o_orderkey', 'o_orderpriority', 'letter')}, 1)"
_KIND = integer_sql(0, 3, 5, "typo", "o_orderkey", "o_orderpriority", "kind")
_F, _O = "(select * from lineitem where l_linestatus = 'F')", "(select * from lineitem where l_linestatus = 'O')"


def _ks_sql(c: str) -> str:
    return f"(select 1 - max(abs(a / na - b / nb)) from (select sum(x) over (order by v range unbounded preceding) a, sum(y) over (order by v range unbounded preceding) b, sum(x) over () na, sum(y) over () nb from (select {c} v, 1 x, 0 y from {_F} union all select {c}, 0, 1 from {_O})))"


def _score_sql() -> str:
    out = [f"select '{c}' column_name, 'ks' measure, round({_ks_sql(c)}, 6) score" for c in ("l_quantity", "l_discount")]
    share = lambda s, v: f"(select count(*) filter (l_returnflag = {v}) / count(*) from {s})"
    out.append(f"select 'l_returnflag' column_name, 'tv' measure, round(1 - (select sum(abs({share(_F, 'f')} - {share(_O, 'f')})) / 2 from (select distinct l_returnflag f from lineitem)), 6) score")
    for c in ("l_quantity", "l_discount", "l_returnflag"):
        out.append(f"select '{c}' column_name, 'uniqueness' measure, round(greatest(0, 1 - 2 * abs((select count(distinct {c}) / count({c}) from {_F}) - (select count(distinct {c}) / count({c}) from {_O}))), 6) score")
        out.append(f"select '{c}' column_name, 'nulls' measure, 1.0::double score")
    return " union all ".join(out)


_P = lambda s, p: f"(select list_sort(list(l_extendedprice))[cast(floor({p} * (count(*) - 1) / 100.0 + 0.5) as bigint) + 1] from {s})"
_PAIRS = [(a, b) for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i + 1 :]]
_DAYS, _BY = pseudonymize.day_shift(17), pseudonymize.number_shift(17)
_PRICE = f"case when {uniform_sql(42, 'sale', 'r', 'price', 'null')} >= 0.1 then round(5.0 + {uniform_sql(42, 'sale', 'r', 'price', 'uniform')} * 195.0, 2) end"


def _lengths_sql() -> str:
    a, b = ("(select length(LastName) v from customers where Country = 'Jeinia' and LastName is not null)", "(select length(LastName) v from customers where Country <> 'Jeinia' and LastName is not null)")
    ks = f"(select max(abs(x / nx - y / ny)) from (select sum(i) over (order by v range unbounded preceding) x, sum(j) over (order by v range unbounded preceding) y, sum(i) over () nx, sum(j) over () ny from (select v, 1 i, 0 j from {a} union all select v, 0, 1 from {b})))"
    at = lambda s, p: f"(select list_sort(list(v))[cast(floor({p} * (count(*) - 1) / 100.0 + 0.5) as bigint) + 1]::double from {s})"
    return f"with p as (select {at(a, 2)} a, {at(a, 98)} b, {at(b, 2)} c, {at(b, 98)} d) select round(0.6 * (1 - {ks}) + 0.4 * case when b > a then greatest(0, least(1, greatest(0, least(b, d) - greatest(a, c)) / (b - a) - 1.5 * (greatest(0, a - c) + greatest(0, d - b)) / (b - a))) else (a = c)::int end, 6) score from p"


def _unique_numbers() -> tuple[int, int]:
    """The step and shift of gen_unique's bijection."""
    ctx = columns.Context(7, "draws", "id", 50_000, row=None)
    a = columns.salt(ctx, "a") % 60_000 or 1
    while math.gcd(a, 60_000) != 1:
        a += 1
    return a, columns.salt(ctx, "b") % 60_000


_UNIQUE = _unique_numbers()

SQL = {
    "gen_shop": f"select 100 + 2 * r id, {_pattern_sql()} code, substr({_UUID}, 1, 8) || '-' || substr({_UUID}, 9, 4) || '-4' || substr({_UUID}, 14, 3) || '-' || substr('89ab', cast(('0x' || substr({_UUID}, 17, 1)) as bigint) % 4 + 1, 1) || substr({_UUID}, 18, 3) || '-' || substr({_UUID}, 21, 12) uid, case when {_WEIGHTED} < 0.1 then 'gold' when {_WEIGHTED} < 0.4 then 'silver' else 'bronze' end tier, ['a', 'b', 'c'][r % 3 + 1] slot from range(500) t(r)",
    "gen_sale": f"with a as (select r + 1 id, 100 + 2 * {integer_sql(0, 499, 42, 'sale', 'r', 'shop_id')} shop_id, 100 + 2 * (r % 500) turn, cast(round(1.0 + {uniform_sql(42, 'sale', 'r', 'quantity', 'uniform')} * 8.0) as bigint) quantity, {_PRICE} price from range(20000) t(r)) select *, round(floor(quantity * price * 100.0 + 0.5) / 100.0, 2) total, case when quantity > 5 then 'big' else 'small' end size from a",
    "gen_distributions": _closed_sql(),
    "gen_conditional": "select r as row, ['x', 'y', 'z'][r % 3 + 1] kind, ['first', 'second', 'other'][r % 3 + 1] note from range(3000) t(r)",
    "gen_weighted_parent": f"with c as (select c_custkey, sum(c_acctbal) over (order by c_custkey) - c_acctbal lo, sum(c_acctbal) over (order by c_custkey) hi, sum(c_acctbal) over () t from customer where c_acctbal > 0), r as (select {uniform_sql(5, 'wp', 'r', 'pick')} u from range(20000) t(r)) select c_custkey, count(*) n from r join c on u >= lo / t and u < hi / t group by 1",
    "gen_series": "with t as (select r, timestamp '2024-01-01' + interval (r) hour ts from range(2160) t(r)) select r as row, round((10 + r * 0.01 + 3 * sin(2 * pi() * r / 24)) * case when isodow(ts) > 5 then 0.5 else 1 end * case when isodow(ts) <= 5 and hour(ts) between 9 and 16 then 1.5 else 1 end, 6) as \"value\" from t",
    "gen_copulas": f"with a as (select r, {uniform_sql(9, 'cop', 'r', 'u')} u, {uniform_sql(9, 'cop', 'r', 't')} t from range(5000) x(r)) select r as row, round(u, 6) u, round(pow(pow(greatest(u, 1e-9), -2) * (pow(greatest(t, 1e-9), {-2 / 3!r}) - 1) + 1, -0.5), 6) clayton, round(-ln(1 + t * (exp(-5) - 1) / (t + (1 - t) * exp(-5 * u))) / 5, 6) frank from a",
    "gen_tree": "select r as node, case when r > 0 then (r - 1) // 3 end parent from range(5000) t(r)",
    "noise_nulls": f"select o_orderkey, case when not ({_hit('null', 'o_orderpriority')} and o_totalprice > 100000) then o_orderpriority end o_orderpriority, o_totalprice from orders",
    "noise_typos": f"with a as (select *, {_TYPO_AT} k, {_LETTER} l, {_KIND} m from orders) select o_orderkey, case when not ({_hit('typo', 'o_orderpriority')}) then o_orderpriority when m = 0 then substr(o_orderpriority, 1, k - 1) || substr(o_orderpriority, k + 1, 1) || substr(o_orderpriority, k, 1) || substr(o_orderpriority, k + 2) when m = 1 then substr(o_orderpriority, 1, k) || l || substr(o_orderpriority, k + 1) when m = 2 then substr(o_orderpriority, 1, k - 1) || substr(o_orderpriority, k + 1) else substr(o_orderpriority, 1, k - 1) || l || substr(o_orderpriority, k + 1) end o_orderpriority from a",
    "noise_outliers": f"select o_orderkey, round(case when {_hit('outlier', 'o_totalprice')} then o_totalprice + case when {uniform_sql(5, 'outlier', 'o_orderkey', 'o_totalprice', 'sign')} < 0.5 then -1 else 1 end * greatest((select max(o_totalprice) - min(o_totalprice) from orders), 1.0) * 3.0 else o_totalprice end, 4) o_totalprice from orders",
    "noise_duplicates": f"select o_orderkey, o_orderstatus from orders union all select o_orderkey, o_orderstatus from orders where {_hit('duplicate', '*')}",
    "noise_drift": f"select o_orderkey, round(case when {_hit('drift', 'o_totalprice')} then o_totalprice + 0.5 * (row_number() over (order by o_orderkey) - 1) else o_totalprice end, 4) o_totalprice from orders",
    "noise_formats": f"select o_orderkey, case when {_hit('format', 'o_orderpriority')} then case when o_orderpriority = upper(o_orderpriority) then lower(o_orderpriority) else upper(o_orderpriority) end else o_orderpriority end o_orderpriority, case when {_hit('format', 'day')} then strftime(o_orderdate, '%Y/%m/%d') else strftime(o_orderdate, '%Y-%m-%d') end as \"day\" from orders",
    "noise_swaps": f"with h as (select *, {_hit('swap', 'o_totalprice')} hit from orders), i as (select *, row_number() over (order by o_orderkey) i from h where hit) select h.o_orderkey, coalesce(m.o_totalprice, h.o_totalprice) o_totalprice from h left join i on i.o_orderkey = h.o_orderkey left join i m on m.i = case when i.i % 2 = 1 then i.i + 1 else i.i - 1 end",
    "noise_truncation": f"select o_orderkey, case when {_hit('truncate', 'o_orderpriority')} then left(o_orderpriority, {integer_sql(1, 'length(o_orderpriority) - 1', 5, 'truncate', 'o_orderkey', 'o_orderpriority', 'keep')}) else o_orderpriority end o_orderpriority from orders",
    "noise_keys": f"select o_orderkey, case when {_hit('fk_violate', 'o_custkey')} then (select max(o_custkey) from orders) + {integer_sql(1, 1_000_000, 5, 'fk_violate', 'o_orderkey', 'o_custkey', 'far')} else o_custkey end o_custkey from orders",
    "noise_gaussian": f"select o_orderkey, round(case when {_hit('gaussian', 'o_totalprice')} then o_totalprice * (1 + sqrt(-2 * ln(1 - {uniform_sql(5, 'gaussian', 'o_orderkey', 'o_totalprice', 'r')})) * cos(2 * pi() * {uniform_sql(5, 'gaussian', 'o_orderkey', 'o_totalprice', 'a')}) * 0.1) else o_totalprice end, 3) o_totalprice from orders",
    "token_map": "select v as \"value\", regexp_replace(regexp_replace(regexp_replace(v, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '0', 'g') shape from (select c_name v from customer union select c_mktsegment from customer union select s_name from supplier)",
    "token_round_trip": "select c_custkey, c_name, c_mktsegment from customer",
    "token_shifts": f"select o_orderkey, strftime(o_orderdate + interval ({_DAYS}) day, '%Y-%m-%d') o_orderdate, strftime(o_orderdate + interval ({_DAYS}) day, '%d.%m.%Y') as \"day\", o_custkey + {_BY} o_custkey from orders",
    "token_verify": "select * from (values ('schema', true), ('rows', true), ('shape:c_name', true)) t(\"check\", ok)",
    "check_validate": "select 'orders' table_name, 'o_missing' column_name, 'missing_column' finding, 'error' severity, 1::bigint n union all select 'orders', 'o_custkey', 'incompatible_type', 'error', 1"
    " union all select * from (select 'requests', 'id', 'duplicate_primary_key', 'error', count(id) - count(distinct id) n from requests) where n > 0 union all select * from (select 'requests', 'id', 'null_primary_key', 'error', count(*) - count(id) n from requests) where n > 0"
    " union all select * from (select 'requests', 'method', 'null_in_not_null', 'error', count(*) - count(method) n from requests) where n > 0 union all select * from (select 'orders', 'o_orderkey', 'duplicate_primary_key', 'error', count(o_orderkey) - count(distinct o_orderkey) n from orders) where n > 0"
    " union all select * from (select 'requests', 'server_id', 'orphan_reference', 'error', count(*) n from requests where server_id is not null and server_id not in (select id from servers)) where n > 0",
    "check_enforce": "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, greatest(10.0, least(40.0, l_quantity)) l_quantity, least(l_linenumber::double, l_quantity) low, greatest(l_linenumber::double, l_quantity) high from lineitem",
    "score_columns": _score_sql(),
    "score_range": f"with p as (select {_P(_F, 2)} a, {_P(_F, 98)} b, {_P(_O, 2)} c, {_P(_O, 98)} d) select round(greatest(0, least(1, greatest(0, least(b, d) - greatest(a, c)) / (b - a) - 1.5 * (greatest(0, a - c) + greatest(0, d - b)) / (b - a))), 6) score from p",
    "score_correlation": "select round(1 - avg(x), 6) score from (" + " union all ".join(f"select abs((select corr({a}, {b}) from {_F}) - (select corr({a}, {b}) from {_O})) x" for a, b in _PAIRS) + ")",
    "token_privacy": "select n \"values\", n tokens, n kept_shape, cast(0 as bigint) holding from (select 286 + count(*) n from (select n_name from nation union select c_name from customer))",
    "score_fk_broken": "select cast(0 as double) score",
    "score_fk": "select round(count(*) filter (customer_id in (select CustomerId from customers)) / count(customer_id), 9) score from requests",
    "score_lengths": _lengths_sql(),
    "enrich_mapping": "select l as \"left\", r as \"right\", round(n, 6) name_score, t type_score, round(0.7 * n + 0.3 * t, 6) score from (select l, r, cast(t as double) t, case when a = b then 1.0 else 1 - levenshtein(a, b) / greatest(length(a), length(b)) end n from (values ('qty', 'quantity', 'quantity', 'quantity', 0.7), ('qty', 'quantity', 'customerName', 'customer_name', 0), ('qty', 'quantity', 'address', 'address', 0), ('cust_name', 'customer_name', 'quantity', 'quantity', 0), ('cust_name', 'customer_name', 'customerName', 'customer_name', 1), ('cust_name', 'customer_name', 'address', 'address', 1)) v(l, a, r, b, t))",
    "sink_sql": "select 'BEGIN;' as \"value\" union all select 'INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES' || chr(10) || string_agg('(' || n_nationkey || ', ''' || replace(n_name, '''', '''''') || ''', ' || n_regionkey || ')', ',' || chr(10) order by n_nationkey) || ';' from nation union all select 'COMMIT;'",
    "gen_unique": f"select r as row, cast((r::hugeint * {_UNIQUE[0]} + {_UNIQUE[1]}) % 60000 + 1 as bigint) id from range(50000) t(r)",
    "scale_dimensions": "select * from (values ('region', 'dimension', (select count(*) from region), cast(null as double)), ('nation', case when (select count(*) from nation) <= 20 or (select count(*) from nation) / (select count(*) from customer) < 0.1 then 'dimension' else 'fixed' end, (select count(*) from nation), null), ('customer', 'actor', (select count(*) from customer), null), ('orders', 'dependent', (select count(*) from orders), (select count(*) from orders) / (select count(*) from customer))) t(table_name, kind, \"rows\", ratio)",
    "scale_plan": "select n as table_name, k as \"rows\", cast(round(k * f) as bigint) planned from (select 'nation' n, count(*) k, 1.0::double f from nation union all select 'customer', count(*), 2.5 from customer union all select 'orders', count(*), 3.0 from orders union all select 'events', count(*), 3.0 from events)",
    "scale_cadence": "select g as \"days\", count(*) n from (select datediff('day', lag(d) over (order by d), d) g from (select distinct o_orderdate::date d from orders)) where g is not null group by 1",
    "scale_size": "select count(*) as \"rows\", round(20.0 + avg(length(c_name)) + avg(length(c_mktsegment)), 6) bytes_per_row, round(count(*) * (20.0 + avg(length(c_name)) + avg(length(c_mktsegment))), 3) bytes from customer",
    "sink_template": "select lpad(cast(n_nationkey as varchar), 4, ' ') || ': ' || lower(n_name) as \"value\" from nation",
    "sink_csv_flat": "select vec_id, '[' || array_to_string(list_transform(embedding, lambda x: cast(trunc(x * 100::float) as int)), ',') || ']' scaled from embeddings",
    "scan_companion": "select cast(o_orderkey as varchar) o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else o_orderstatus end o_orderstatus from orders",
}
