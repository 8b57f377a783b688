"""Queries of the learning operators, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.learn import behavior, correlate, fit, keys, profile, series, state
from fathom.sources.tables import table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def learn_numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.numeric_profile(table(spark, sf_dir, "lineitem"), NUMBERS), 5)


def learn_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("flag_or_null", F.nullif("l_returnflag", F.lit("A")))
    return _rounded(profile.column_counts(li, ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "flag_or_null"]))


def learn_text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.text_profile(table(spark, sf_dir, "customers"), ["FirstName", "Email", "Phone", "Company"]))


def learn_temporal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.temporal_profile(table(spark, sf_dir, "lineitem"), ["l_shipdate"])


def learn_decimal_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.decimal_places(table(spark, sf_dir, "lineitem"), ["l_discount", "l_quantity"])


def learn_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customers").withColumns({"id_text": F.col("CustomerId").cast("string"), "day_text": F.date_format("created_at", "yyyy-MM-dd")})
    return profile.inferred_types(c, ["id_text", "day_text", "Email", "Country", "LastName"])


def learn_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.category_shares(table(spark, sf_dir, "orders"), "o_orderpriority"))


def learn_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.traits(table(spark, sf_dir, "lineitem"), NUMBERS)


def learn_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of all families for two columns."""
    out = fit.likelihoods(fit.sufficient(table(spark, sf_dir, "part"), ["p_retailprice", "p_size"]))
    return out.select("column_name", "family", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("aic", 2).alias("aic"))


def learn_fit_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the family that made a column is the one found, with the winner's distance, for 20 000 values of each."""
    from fathom.operators.generate import columns, engine

    made = {"gamma": {"shape": 2.5, "scale": 2.0}, "beta": {"alpha": 2.0, "beta": 5.0}, "poisson": {"lambda": 4.0}, "normal": {"mean": 10.0, "std_dev": 2.0}, "exponential": {"lambda": 0.5}, "log_normal": {"mu": 1.0, "sigma": 0.5}, "pareto": {"scale": 2.0, "shape": 3.0}, "uniform": {"min": 2.0, "max": 5.0}}
    ctx = {f: columns.Context(5, "recovery", f, 20_000) for f in made}
    df = engine.row_source(spark, 20_000).select(*[columns.distribution_(ctx[f], f, p).alias(f) for f, p in made.items()])
    found = fit.goodness(df, list(made))
    near = F.when(F.col("family") == "poisson", F.lit(True)).otherwise(F.col("ks") < 0.02)
    return found.select(F.col("column_name").alias("made_by"), "family", near.alias("near"))


def learn_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fit.goodness(table(spark, sf_dir, "customer"), ["c_acctbal"])
    return out.select("column_name", "family", F.round("ks", 6).alias("ks"))


def learn_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.pearson(table(spark, sf_dir, "lineitem"), NUMBERS).select("left", "right", "n", F.round("r", 9).alias("r"))


def learn_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select("left", "right", "n", F.round("r", 9).alias("r"))


def learn_cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlate.cramers_v(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"), 9)


def learn_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlate.dependencies(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"]))


def learn_derived_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").withColumn("label", F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")))
    return _rounded(correlate.derived_text(n, "label", ["c_mktsegment", "c_nationkey"], ["", "-", " "]))


def learn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlate.grid(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


def learn_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlate.conditional(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal"), 4)


def learn_conditional_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlate.conditional_strength(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"))


def learn_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("u"), F.col("l_extendedprice").alias("total"))
    return _rounded(correlate.arithmetic(li, ["q", "u", "total"]))


def learn_orderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return correlate.orderings(li, ["l_discount", "l_quantity", "net", "l_extendedprice"])


def learn_primary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.primary_keys({n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders", "events", "documents")}, relaxed=True)


def learn_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey"}
    return _rounded(keys.foreign_keys({n: table(spark, sf_dir, n) for n in names}, names, relaxed=True))


def learn_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return series.sort_order(e, ["event_id"], "ts").unionByName(series.sort_order(e, ["event_id"], "user_id"))


def learn_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trend(table(spark, sf_dir, "events"), ["event_id"], "value").select("column_name", "n", F.round("slope", 9).alias("slope"), F.round("r2", 9).alias("r2"), "trending")


def learn_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.autocorrelation(table(spark, sf_dir, "events"), ["event_id"], "value", [1, 2, 3, 7, 24]))


def learn_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons of daily request counts per method."""
    d = table(spark, sf_dir, "requests").where("method is not null").groupBy("method", F.to_date("requested_at").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return series.seasons(d, "method", "day", "n")


def learn_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.interval_pattern(table(spark, sf_dir, "events"), "user_id", "ts"), 2)


def learn_time_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.time_patterns(table(spark, sf_dir, "events"), "user_id", "ts")


def learn_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.calendar_counts(table(spark, sf_dir, "events"), "ts")


def learn_calendar_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.calendar_pattern(table(spark, sf_dir, "events"), "ts"), 4)


def learn_relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.relative_times(table(spark, sf_dir, "requests"), "requested_at", "loaded_at"), 3)


def learn_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct co-occurring values with their counts."""
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


def learn_actor_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(behavior.actor_profiles(table(spark, sf_dir, "events"), "user_id", "ts"))


def learn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(behavior.features(behavior.actor_profiles(table(spark, sf_dir, "events"), "user_id", "ts")).select("actor", "f0", "f1", "f2", "f32"))


def learn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.segments(behavior.features(behavior.actor_profiles(table(spark, sf_dir, "events"), "user_id", "ts")))


def learn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of nations that trade with each other."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    trade = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return _rounded(behavior.graph_metrics(behavior.edges(trade, "c_nationkey", "s_nationkey")))


def learn_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of requests merged from the partials of its loads, one of them given twice."""
    r = table(spark, sf_dir, "requests").select("load_id", "response_time_ms", "bytes_sent", "status_code")
    parts = state.partials(r, "load_id", "requests")
    merged = state.merged(state.ingest(parts, parts.where("chunk = '1'")))
    return _rounded(merged.select("table_name", "column_name", "rows", "null_rate", "mean", "std", "low", "high"), 4)


def learn_state_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of columns whose chunks differ in type."""
    r = table(spark, sf_dir, "requests")
    whole = r.select(F.lit("a").alias("load_id"), F.col("status_code").alias("x"), F.col("bytes_sent").alias("y"), F.col("status_code").alias("z"))
    other = r.select(F.lit("b").alias("load_id"), F.col("response_time_ms").alias("x"), F.col("status_code").alias("y"), F.col("path").alias("z"))
    parts = state.partials(whole, "load_id", "requests").unionByName(state.partials(other, "load_id", "requests"))
    return state.merged(parts).select("column_name", "kind", "rows")


def learn_state_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent status codes and methods, merged from the loads, with the bounds of their counts."""
    parts = state.top_partials(table(spark, sf_dir, "requests"), "load_id", "requests", ["status_code", "method"])
    return state.top_merged(parts, 10).select("column_name", "value", "lower", "upper")


def learn_state_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample merged from those of the loads against that of one pass: rows, and rows of only one of them."""
    r = table(spark, sf_dir, "requests").select("load_id", "id", "loaded_at").distinct().where("load_id is not null")
    merged = state.reservoir_merged(state.reservoir(r, "load_id", ["id", "loaded_at"], 500), ["id", "loaded_at"], 500).select("id", "loaded_at", F.lit(1).alias("a"))
    direct = state.reservoir(r.withColumn("load_id", F.lit(0)), "load_id", ["id", "loaded_at"], 500).select(F.col("id").alias("i"), F.col("loaded_at").alias("t"), F.lit(1).alias("b"))
    both = merged.join(direct, F.col("id").eqNullSafe(F.col("i")) & F.col("loaded_at").eqNullSafe(F.col("t")), "full_outer")
    return both.agg(F.count("a").alias("rows"), F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("differ"))


def learn_state_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows generated from a model that the merged state became: as many as asked for, within the ranges learned."""
    from fathom.operators.generate import engine

    r = table(spark, sf_dir, "requests").select("load_id", "bytes_sent", "status_code")
    model = state.model_of(state.merged(state.partials(r, "load_id", "requests")), "requests", 5000)
    span = r.agg(F.min("bytes_sent").alias("a"), F.max("bytes_sent").alias("z"))
    made = engine.generate_table(spark, model, "requests").join(F.broadcast(span))
    return made.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.col("bytes_sent").between(F.col("a"), F.col("z")), 1)).alias("outside"))


def learn_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user does most."""
    return _rounded(behavior.field_preferences(table(spark, sf_dir, "events"), "user_id", ["event_type"]))


def learn_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.ranges(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])


def learn_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(correlate.grids(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"]))


def learn_trend_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.trend_noise(table(spark, sf_dir, "events"), ["event_id"], "value"), 9)


def learn_coverage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts of sketches against exact ones: per column the exact count, and whether the estimate is within 3 %."""
    li = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("chunk"), "l_orderkey", "l_partkey", "l_quantity")
    found = state.merged(state.partials(li, "chunk", "lineitem")).select("column_name", F.col("distinct").alias("estimate"))
    exact = profile.column_counts(li, ["l_orderkey", "l_partkey", "l_quantity"]).select("column_name", "distinct")
    return exact.join(found, "column_name").select("column_name", "distinct", (F.abs(F.col("estimate") / F.col("distinct") - 1) <= 0.03).alias("near"))


def learn_segment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the segments: actors, and whether there are at least two and none has fewer than two actors."""
    sizes = learn_segments(spark, sf_dir).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("actors"), ((F.count(F.lit(1)) >= 2) & (F.min("n") >= 2)).alias("fit"))


def learn_season_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period found in series made with one, and in one without."""
    t = spark.range(600).select(F.explode(F.array(*[F.struct(F.lit(f"p{p}").alias("series"), F.lit(p).alias("p")) for p in (7, 24, 60, 0)])).alias("x"), F.col("id").alias("at")).select("x.*", "at")
    wave = F.when(F.col("p") > 0, F.sin(F.col("at") * (2 * 3.141592653589793) / F.col("p"))).otherwise((F.xxhash64("at") % 1000) / 1000.0)
    return series.seasons(t.withColumn("v", wave), "series", "at", "v").select("series", "n", "period")


def learn_time_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern found in times every minute, every day within seconds, and in times without one."""
    jitter = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    made = {"minute": F.col("id") * 60.0, "day": F.col("id") * 86_400.0 + jitter * 5, "none": F.col("id") * 600.0 + jitter * 1800}
    t = spark.range(400).select(F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.timestamp_seconds(F.lit(1.7e9) + v).alias("at")) for k, v in made.items()])).alias("x")).select("x.*")
    return series.time_patterns(t, "series", "at").select("series", "n", (F.col("pattern") == "fixed_interval").alias("fixed"))


def learn_state_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "requests")
    return state.correlations(state.comoments(r, "load_id", ["response_time_ms", "bytes_sent", "status_code"])).select("left", "right", "n", F.round("r", 7).alias("r"))


def learn_state_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign key evidence from sketches."""
    parts = state.partials(table(spark, sf_dir, "orders").select(F.lit(1).alias("chunk"), "o_custkey"), "chunk", "orders")
    parts = parts.unionByName(state.partials(table(spark, sf_dir, "customer").select(F.lit(1).alias("chunk"), "c_custkey"), "chunk", "customer"))
    return state.coverage(parts, ("orders", "o_custkey"), ("customer", "c_custkey"), 0.6)


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("learn_") and callable(v)}

_ROUND_TIME = "(epoch_us(ts) // 1000)"


def _profile_sql() -> str:
    rows = []
    for c in NUMBERS:
        ps = ", ".join(f"round(list_sort(list(cast({c} as double)))[cast(floor({p} * (count({c}) - 1) / 100.0 + 0.5) as bigint) + 1], 5) p{p}" for p in profile.PERCENTILES)
        rows.append(f"select '{c}' column_name, count({c}) n, round(min({c}), 5) as \"min\", round(max({c}), 5) as \"max\", round(avg({c}), 5) mean, round(stddev_samp({c}), 5) std, round(skewness({c}), 5) skewness, round(kurtosis({c}), 5) kurtosis, {ps} from lineitem")
    return " union all ".join(rows)


def _counts_sql() -> str:
    src = "(select *, nullif(l_returnflag, 'A') flag_or_null from lineitem)"
    return " union all ".join(f"select '{c}' column_name, count(*) as \"rows\", count(*) - count({c}) nulls, round((count(*) - count({c})) / count(*), 6) null_rate, 0.0::double empty_rate, least(count(distinct {c}), 100000) as \"distinct\", round(least(count(distinct {c}), 100000) / count({c}), 6) cardinality_ratio from {src}" for c in ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "flag_or_null"))


def _text_sql() -> str:
    rate = lambda c: ", ".join(f"round(avg(regexp_matches({c}, '{p}')::int), 6) {k}_rate" for k, p in profile.PATTERNS.items())
    return " union all ".join(f"select '{c}' column_name, min(length({c})) min_length, max(length({c})) max_length, round(avg(length({c})), 6) avg_length, {rate(c)} from customers" for c in ("FirstName", "Email", "Phone", "Company"))


def _pearson_sql() -> str:
    return " union all ".join(f"select '{a}' as \"left\", '{b}' as \"right\", count(*) n, round(corr({a}, {b}), 9) r from lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :])


def _dependency_sql() -> str:
    cols = ("p_brand", "p_type", "p_size")
    return " union all ".join(f"select '{a}' determinant, '{b}' dependent, count(*) groups, round(avg((k = 1)::int), 6) ratio from (select {a}, count(distinct {b}) k from part group by 1)" for a in cols for b in cols if a != b)


def _fit_sql() -> str:
    out = []
    for c in ("p_retailprice", "p_size"):
        x = f"cast({c} as double)"
        s = f"(select count(*) n, avg({x}) m, var_pop({x}) v, avg(ln({x})) lm, var_pop(ln({x})) lv, min({x}) lo, max({x}) hi, sum(ln({x})) sl, sum(lgamma({x} + 1)) lg, bool_and({x} = floor({x})) whole from part)"
        head = f"select '{c}' column_name, n, "
        out += [
            f"{head}'uniform' family, round(lo, 6) a, round(hi, 6) b, round(4 + 2 * n * ln(hi - lo), 2) aic from {s}",
            f"{head}'normal' family, round(m, 6) a, round(sqrt(v), 6) b, round(4 + n * (ln(2 * pi()) + ln(v) + 1), 2) aic from {s}",
            f"{head}'log_normal' family, round(lm, 6) a, round(sqrt(lv), 6) b, round(4 + 2 * sl + n * (ln(2 * pi()) + ln(lv) + 1), 2) aic from {s}",
            f"{head}'exponential' family, round(1 / m, 6) a, null b, round(2 + 2 * (n * ln(m) + n), 2) aic from {s}",
            f"{head}'pareto' family, round(lo, 6) a, round(n / (sl - n * ln(lo)), 6) b, round(4 - 2 * (n * ln(n / (sl - n * ln(lo))) + n * (n / (sl - n * ln(lo))) * ln(lo) - (n / (sl - n * ln(lo)) + 1) * sl), 2) aic from {s}",
            f"select column_name, n, 'gamma' family, round(k, 6) a, round(m / k, 6) b, round(4 - 2 * ((k - 1) * sl - n * k - n * k * ln(m / k) - n * lgamma(k)), 2) aic from (select '{c}' column_name, *, (3 - g + sqrt((g - 3) * (g - 3) + 24 * g)) / (12 * g) k from (select *, ln(m) - lm g from {s}))",
            f"select column_name, n, 'zipf' family, round(hi, 6) a, round(p, 6) b, round(4 - 2 * (-p * sl - n * ln((select sum(pow(k, -p)) from range(1, cast(hi as bigint) + 1) r(k)))), 2) aic from (select '{c}' column_name, *, 1 + n / sl p from {s} where whole and lo >= 1) where p > 1 and p < 10",
            f"{head}'poisson' family, round(m, 6) a, null b, round(2 - 2 * (n * m * ln(m) - n * m - lg), 2) aic from {s} where whole",
        ]
    return " union all ".join(out)


def _order_sql() -> str:
    cols = ("l_discount", "l_quantity", "net", "l_extendedprice")
    src = "(select *, l_extendedprice * (1 - l_discount) net from lineitem)"
    return " union all ".join(f"select '{a}' low, '{b}' high from {src} having bool_and({a} <= {b})" for a in cols for b in cols if a != b)


def _arithmetic_sql() -> str:
    cols, src = ("q", "u", "total"), "(select l_quantity q, round(l_extendedprice / l_quantity, 2) u, l_extendedprice total from lineitem)"
    out = []
    for t in cols:
        a, b = (c for c in cols if c != t)
        for x, y, ops in ((a, b, "+-*/"), (b, a, "-/")):
            out += [f"select '{t}' target, '{x}' as \"left\", '{o}' as op, '{y}' as \"right\", round(avg((abs({t} - {x} {o} {y if o not in '-' else y}) <= 0)::int), 6) share from {src} where false" for o in ""]
            for o in ops:
                out.append(f"select '{t}' target, '{x}' as \"left\", '{o}' as op, '{y}' as \"right\", round(avg((abs({t} - ({x} {o} {y})) <= 0.01 * greatest(1.0, abs({t})))::int), 6) share from {src}")
    return f"select * from ({' union all '.join(out)}) where share >= 0.95"


def _calendar_sql() -> str:
    part = lambda p, f, k, limit: f"select '{p}' part, round(sum(pow(c - n / {k}.0, 2) / (n / {k}.0)), 4) chi2, sum(pow(c - n / {k}.0, 2) / (n / {k}.0)) > {limit} patterned from (select d, (select count(*) from events where {f} = d) c, (select count(*) from events) n from range({k}) t(d))"
    return f"{part('weekday', 'isodow(ts) - 1', 7, series.CHI_WEEKDAYS)} union all {part('hour', 'hour(ts)', 24, series.CHI_HOURS)}"


_SHARES = ", ".join([f"round(count(*) filter (hour(ts) = {h}) / count(*), 6) h{h}" for h in range(24)] + [f"round(count(*) filter (isodow(ts) = {d + 1}) / count(*), 6) d{d}" for d in range(7)])
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "supplier": "s_suppkey"}


def _fk_sql() -> str:
    found = [("nation", "n_regionkey", "region", "r_regionkey", 1.0), ("customer", "c_nationkey", "nation", "n_nationkey", 1.0), ("supplier", "s_nationkey", "nation", "n_nationkey", 1.0), ("orders", "o_custkey", "customer", "c_custkey", 0.6)]
    return " union all ".join(
        f"select '{t}' from_table, '{c}' from_column, '{p}' to_table, '{k}' to_column, cast({s} as double) name_score, round(o, 6) as \"overlap\", case when u >= 0.95 then 'one_to_one' else 'many_to_one' end kind, round(0.4 * {s} + 0.4 * o + 0.1, 6) confidence"
        f" from (select (select count(distinct {c}) from {t} where {c} in (select {k} from {p})) / count(distinct {c}) o, count(distinct {c}) / count({c}) u from {t})"
        for t, c, p, k, s in found
    )



def _types_sql() -> str:
    src = "(select cast(CustomerId as varchar) id_text, strftime(created_at, '%Y-%m-%d') day_text, Email, Country, LastName from customers)"
    out = []
    for c in ("id_text", "day_text", "Email", "Country", "LastName"):
        rate = lambda p, c=c: f"avg(regexp_matches(trim({c}), '{p}')::int)"
        tests = [("email", rate(profile.PATTERNS["email"]), 0.95), ("url", rate(profile.PATTERNS["url"]), 0.95), ("integer", rate("^[+-]?[0-9]+$"), 0.95), ("float", rate(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), 0.95), ("bool", f"avg((lower(trim({c})) in ('true', 'false', 'yes', 'no', 't', 'f', 'y', 'n'))::int)", 0.95), ("uuid", rate(profile.PATTERNS["uuid"]), 0.95), ("date", rate(profile.PATTERNS["date"]), 0.90)]
        cases = " ".join(f"when {e} >= {least} then '{k}'" for k, e, least in tests)
        out.append(f"select '{c}' column_name, case {cases} when count(distinct {c}) <= case when count({c}) <= 50 then 0.8 when count({c}) <= 200 then 0.5 else 0.05 end * count({c}) then 'category' else 'text' end inferred from {src} where {c} <> ''")
    return " union all ".join(out)


def _traits_sql() -> str:
    out = []
    for c in NUMBERS:
        at = lambda p, c=c: f"list_sort(list(cast({c} as double)))[cast(floor({p} * (count({c}) - 1) / 100.0 + 0.5) as bigint) + 1]"
        ratio = f"count(distinct {c}) / count({c})"
        out.append(f"select '{c}' column_name, case when {ratio} >= 0.99 then 'unique' when {ratio} >= 0.3 then 'high' when {ratio} >= 0.01 then 'medium' else 'low' end cardinality, case when skewness({c}) > 0.5 then 'right_skewed' when skewness({c}) < -0.5 then 'left_skewed' when kurtosis({c}) > 3 then 'heavy_tailed' when kurtosis({c}) < -1 and ({at(90)} - {at(10)}) / (max({c}) - min({c})) > 0.7 then 'flat' when abs(kurtosis({c})) <= 1 then 'bell' else 'other' end shape from lineitem")
    return " union all ".join(out)


_GRAPH_SQL = (
    "with e as (select cast(c_nationkey as varchar) src, cast(s_nationkey as varchar) dst, count(*) n from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey group by 1, 2),"
    " d as (select node, sum(n) k from (select src node, n from e union all select dst, n from e) group by 1),"
    " near as (select src, dst from (select src, dst, row_number() over (partition by src order by dst) r from e where src <> dst and src in (select distinct src from e order by src limit 100)) where r <= 20),"
    " p as (select a.src, exists (select 1 from e where (e.src = a.dst and e.dst = b.dst) or (e.src = b.dst and e.dst = a.dst)) closed from near a join near b on a.src = b.src and a.dst < b.dst),"
    " m as (select (select count(*) from d) nodes, (select count(*) from e) edges, (select avg(k) from d) mean_degree, (select stddev_pop(k) / avg(k) from d) cv, (select count(*) from e where exists (select 1 from e b where b.src = e.dst and b.dst = e.src)) / (select count(*) from e) reciprocity, coalesce((select avg(closed::int) from p), 0) clustering)"
    " select nodes, edges, round(mean_degree, 6) mean_degree, round(cv, 6) degree_cv, round(reciprocity, 6) reciprocity, round(clustering, 6) clustering, case when reciprocity < 0.2 and cv > 1 then 'hierarchical' when cv > 1.5 then 'scale_free' when clustering > 0.3 and reciprocity > 0.3 then 'small_world' when cv < 0.5 and reciprocity > 0.4 then 'erdos_renyi' else 'custom' end as class from m"
)

SQL = {
    "learn_types": _types_sql(),
    "learn_traits": _traits_sql(),
    "learn_graph": _GRAPH_SQL,
    "learn_numeric_profile": _profile_sql(),
    "learn_column_counts": _counts_sql(),
    "learn_text_profile": _text_sql(),
    "learn_temporal_profile": "select 'l_shipdate' column_name, (epoch_us(min(l_shipdate)) // 1000) as first, (epoch_us(max(l_shipdate)) // 1000) as last, 'day' granularity from lineitem",
    "learn_decimal_places": " union all ".join(f"select '{c}' column_name, length(rtrim(coalesce(nullif(split_part(cast({c} as varchar), '.', 2), ''), ''), '0')) places, count(*) n from lineitem group by 2" for c in ("l_discount", "l_quantity")),
    "learn_categories": "select o_orderpriority as \"value\", count(*) n, round(count(*) / (select count(*) from orders), 6) share from orders group by 1",
    "learn_fit": _fit_sql(),
    "learn_fit_recovery": " union all ".join(f"select '{f}' made_by, '{f}' family, true near" for f in ("gamma", "beta", "poisson", "normal", "exponential", "log_normal", "pareto", "uniform")),
    "learn_state_types": "select c column_name, k kind, cast(2 * n as bigint) as \"rows\" from (values ('x', 'double'), ('y', 'bigint'), ('z', 'string')) v(c, k), (select count(*) n from requests)",
    "learn_state_top": "select column_name, value, lower, lower as \"upper\" from (select *, row_number() over (partition by column_name order by lower desc, value) r from (select 'status_code' column_name, cast(status_code as varchar) as value, count(*) lower from requests where status_code is not null and load_id is not null group by all union all select 'method', method, count(*) from requests where method is not null and load_id is not null group by all)) where r <= 10",
    "learn_state_reservoir": 'select least(500, count(*)) as "rows", cast(0 as bigint) differ from (select distinct load_id, id, loaded_at from requests where load_id is not null)',
    "learn_state_model": 'select cast(5000 as bigint) as "rows", cast(0 as bigint) outside',
    "learn_preferences": "select user_id actor, 'event_type' column_name, event_type as value, n, round(n / t, 6) share from (select user_id, event_type, count(*) n, sum(count(*)) over (partition by user_id) t, row_number() over (partition by user_id order by count(*) desc, event_type) r from events where user_id is not null and event_type is not null group by 1, 2) where r = 1",
    "learn_grids": "select * from (select 'o_orderstatus' as \"left\", 'o_orderpriority' as \"right\", count(distinct o_orderstatus) left_values, count(distinct o_orderpriority) right_values, count(distinct (o_orderstatus, o_orderpriority)) pairs, round(count(distinct (o_orderstatus, o_orderpriority)) / (count(distinct o_orderstatus) * count(distinct o_orderpriority)), 6) completeness from orders) where completeness >= 0.9",
    "learn_ranges": "select 'c_acctbal' column_name, case when min(c_acctbal) >= 0 then 0.0 else min(c_acctbal) end low, max(c_acctbal) high from customer union all select 'c_nationkey', 0.0, cast(max(c_nationkey) as double) from customer",
    "learn_trend_noise": "select 'value' column_name, count(d) n, round(stddev_samp(d) / sqrt(2), 9) noise from (select value - lag(value) over (order by event_id) d from events where value is not null)",
    "learn_coverage_rules": " union all ".join(f"select '{c}' column_name, count(distinct {c}) as \"distinct\", true near from lineitem" for c in ("l_orderkey", "l_partkey", "l_quantity")),
    "learn_segment_rules": "select count(distinct user_id) actors, true fit from events where user_id is not null",
    "learn_season_rules": "select s series, cast(600 as bigint) n, cast(p as int) period from (values ('p7', 7), ('p24', 24), ('p60', 60), ('p0', 0)) v(s, p)",
    "learn_time_rules": "select s series, cast(400 as bigint) n, f fixed from (values ('minute', true), ('day', true), ('none', false)) v(s, f)",
    "learn_best_fit": "with o as (select c_acctbal x, count(*) k from customer group by 1), u as (select x, k, sum(k) over (order by x) cum, sum(k) over () n, min(x) over () lo, max(x) over () hi from o) select 'c_acctbal' column_name, 'uniform' family, round(max(greatest(abs(cum / n - (x - lo) / (hi - lo)), abs((cum - k) / n - (x - lo) / (hi - lo)))), 6) ks from u",
    "learn_pearson": _pearson_sql(),
    "learn_spearman": "with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 b from part) select 'p_size' as \"left\", 'p_retailprice' as \"right\", count(*) n, round(corr(a, b), 9) r from r",
    "learn_cramers_v": "with o as (select a, b, coalesce(k, 0) k from (select distinct l_returnflag a from lineitem) cross join (select distinct l_linestatus b from lineitem) left join (select l_returnflag a, l_linestatus b, count(*) k from lineitem group by 1, 2) using (a, b)), e as (select k, sum(k) over (partition by a) * sum(k) over (partition by b) / sum(k) over () x, sum(k) over () n from o) select 'l_returnflag' as \"left\", 'l_linestatus' as \"right\", cast(max(n) as bigint) n, round(sqrt(sum((k - x) * (k - x) / x) / max(n)), 9) v from e",
    "learn_dependencies": _dependency_sql(),
    "learn_derived_text": " union all ".join(f"select 'label' target, '{a}' as \"left\", '{s}' separator, '{b}' as \"right\", round(avg((c_mktsegment || '-' || c_nationkey = {a} || '{s}' || {b})::int), 6) share from customer" for a, b in (("c_mktsegment", "c_nationkey"), ("c_nationkey", "c_mktsegment")) for s in ("", "-", " ")),
    "learn_grid": "select 'o_orderstatus' as \"left\", 'o_orderpriority' as \"right\", count(distinct o_orderstatus) left_values, count(distinct o_orderpriority) right_values, count(distinct (o_orderstatus, o_orderpriority)) pairs, round(count(distinct (o_orderstatus, o_orderpriority)) / (count(distinct o_orderstatus) * count(distinct o_orderpriority)), 6) completeness from orders",
    "learn_conditional": "select c_mktsegment category, count(*) n, round(avg(c_acctbal), 4) mean, round(stddev_samp(c_acctbal), 4) std from customer group by 1 having count(*) >= 5",
    "learn_conditional_strength": "with g as (select avg(o_totalprice) m from orders group by o_orderpriority having count(*) >= 5) select 'o_orderpriority' category, 'o_totalprice' as \"value\", count(*) categories, round(stddev_pop(m) / abs(avg(m)), 6) cv, stddev_pop(m) / abs(avg(m)) >= 0.15 depends from g",
    "learn_arithmetic": _arithmetic_sql(),
    "learn_orderings": _order_sql(),
    "learn_primary_keys": " union all ".join(f"select '{t}' table_name, '{c}' column_name, count(*) as \"rows\", count(distinct {c}) as \"distinct\", count(distinct {c}) = count(*) and count({c}) = count(*) is_key from {t}" for t, c in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("nation", "n_regionkey"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("orders", "o_orderkey"), ("orders", "o_custkey"), ("events", "event_id"), ("events", "user_id"), ("documents", "doc_id"))),
    "learn_foreign_keys": _fk_sql(),
    "learn_sort_order": " union all ".join(f"select '{c}' column_name, count(d) pairs, case when bool_and(d >= 0) then 'ascending' when bool_and(d <= 0) then 'descending' else 'unsorted' end direction from (select {e} - lag({e}) over (order by event_id) d from events)" for c, e in (("ts", _ROUND_TIME), ("user_id", "user_id"))),
    "learn_trend": "select 'value' column_name, count(*) n, round(regr_slope(value, k), 9) slope, round(regr_r2(value, k), 9) r2, regr_r2(value, k) >= 0.3 trending from (select value, row_number() over (order by event_id) - 1 k from events)",
    "learn_autocorrelation": "with v as (select value - avg(value) over () v, row_number() over (order by event_id) k from events) select cast(lag as int) as lag, count(*) n, round(sum(a.v * b.v) / (select sum(v * v) from v), 6) acf from (select unnest([1, 2, 3, 7, 24]) lag) join v a on true join v b on b.k = a.k + lag group by 1",
    "learn_intervals": "with g as (select user_id series, ((epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) over (partition by user_id order by ts)) / 1000.0 gap from events), s as (select series, count(*) n, avg(gap) filter (gap > 0) m, stddev_pop(gap) filter (gap > 0) / avg(gap) filter (gap > 0) cv from g group by 1) select series, n, round(m, 2) mean_gap, round(cv, 2) cv, case when n >= 3 and cv < 0.05 then 'fixed_interval' else 'variable' end pattern, case when n >= 3 and cv < 0.05 then round(greatest(0.5, least(1.0, 1 - 10 * cv)), 2) end confidence from s",
    "learn_calendar": "select isodow(ts) - 1 weekday, hour(ts) as \"hour\", count(*) n from events group by 1, 2",
    "learn_calendar_pattern": _calendar_sql(),
    "learn_relative_times": "select 'requested_at' earlier, 'loaded_at' later, count(d) n, round(avg((d >= 0)::int), 3) in_order, round(avg(d), 3) mean_gap, round(stddev_samp(d), 3) std_gap from (select ((epoch_us(loaded_at) // 1000) - (epoch_us(requested_at) // 1000)) / 1000.0 d from requests)",
    "learn_dictionary": "select p_brand, p_type, count(*) n from part group by 1, 2",
    "learn_actor_profiles": f"select user_id actor, count(*) events, round(((epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000)) / 86400000.0, 6) span_days, {_SHARES} from events group by 1",
    "learn_features": "with p as (select user_id actor, ln(count(*) + 1) f0, ((epoch_us(max(ts)) // 1000) - (epoch_us(min(ts)) // 1000)) / 86400000.0 f1, count(*) filter (hour(ts) = 0) / count(*) f2, count(*) filter (isodow(ts) = 7) / count(*) f32 from events group by 1) select actor, " + ", ".join(f"round(coalesce((f{i} - avg(f{i}) over ()) / nullif(stddev_pop(f{i}) over (), 0), 0), 6) f{i}" for i in (0, 1, 2, 32)) + " from p",
    "learn_state_merge": " union all ".join(f"select 'requests' table_name, '{c}' column_name, count(*) as \"rows\", round((count(*) - count({c})) / count(*), 4) null_rate, round(avg({c}), 4) mean, round(stddev_samp({c}), 4) std, cast(min({c}) as double) low, cast(max({c}) as double) high from requests" for c in ("response_time_ms", "bytes_sent", "status_code")),
    "learn_state_correlations": " union all ".join(f"select '{a}' as \"left\", '{b}' as \"right\", count(*) n, round(corr({a}, {b}), 7) r from requests where {a} is not null and {b} is not null" for a, b in (("response_time_ms", "bytes_sent"), ("response_time_ms", "status_code"), ("bytes_sent", "status_code"))),
}
