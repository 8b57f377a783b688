import math
import random
from statistics import mean, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import relational as R
from fathom.operators.learn import behavior, correlate, fit, keys, profile, series, state


def test_numeric_profile_matches_hand_computation(spark):
    v = [1.0, 2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(x, None) for x in v] + [(None, None), (float("nan"), None)], "a double, b double")
    got = {r.column_name: r for r in profile.numeric_profile(df, ["a", "b"]).collect()}
    a = got["a"]
    assert (a.n, a.min, a.max, a.mean, a.p50, a.p1, a.p99) == (5, 1, 5, 3, 3, 1, 5) and abs(a.std - stdev(v)) < 1e-12 and abs(a.skewness) < 1e-12 and abs(a.kurtosis + 1.2) < 1e-9
    assert got["b"].n == 0 and got["b"].mean is None and got["b"].p50 is None


def test_distinct_counts_are_not_cut(spark):
    r = profile.column_counts(spark.range(100_001), ["id"]).first()
    assert r.distinct == r.rows == 100_001 and r.cardinality_ratio == 1.0


def test_ranks_prefix_sums_and_percentiles(spark):
    rnd = random.Random(1)
    v = [rnd.choice([1, 2, 2, 3, 5, 8]) for _ in range(300)]
    df = spark.createDataFrame([(i, x, None if i % 50 == 0 else x) for i, x in enumerate(v)], "id long, v long, __ps_value long").repartition(5)
    order = sorted(v)
    ranks = {r.v: r["rank"] for r in R.average_ranks(df, "v").collect()}
    assert ranks == {x: order.index(x) + (order.count(x) + 1) / 2 for x in set(v)}
    idx = {r.id: r.row_index for r in R.row_index(df.select("id", "v"), ["v", "id"]).collect()}
    assert [i for i, _ in sorted(idx.items(), key=lambda x: x[1])] == [i for i, _ in sorted(enumerate(v), key=lambda x: (x[1], x[0]))]
    assert R.exact_percentiles(df.limit(0), ["v"], [50]).collect() == []


def test_lag_and_scan_of_hot_keys(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), i, rnd.choice([None, rnd.randrange(100)])) for i in range(400)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
    last, top, lag, best = {}, {}, {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        lag[i] = last.get(k)
        last[k] = v
        top[k] = max(x for x in (top.get(k), v, -1) if x is not None)
        best[i] = top[k]
    assert {r.i: r.previous for r in R.lagged(df, ["k"], ["i"], "v").collect()} == lag
    got = R.prefix_scan(df, ["i"], F.coalesce("v", F.lit(-1)), ["k"], "m", "max").collect()
    assert {r.i: r.m for r in got} == best
    assert R.lagged(df.limit(0), ["k"], ["i"], "v").collect() == []


def test_ks_and_tv(spark):
    a, b = [1, 2, 2, 3], [2, 3, 3, 9]
    d = R.ks_distance(*(spark.createDataFrame([(float(x),) for x in s], "v double") for s in (a, b)), "v").first().distance
    cdf = lambda s, x: sum(y <= x for y in s) / len(s)
    assert abs(d - max(abs(cdf(a, x) - cdf(b, x)) for x in a + b)) < 1e-12
    t = R.total_variation(*(spark.createDataFrame([(str(x),) for x in s], "v string") for s in (a, b)), "v").first().similarity
    assert abs(t - 0.5) < 1e-12


def test_gap_sampling_and_overlap(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 5), (2, 3)], "a long, s long").withColumn("t", F.timestamp_seconds("s"))
    got = [(r.a, r.m) for r in R.enforce_gap(df, "a", "t", 2000).select("a", (F.unix_millis("t") / 1000).alias("m")).orderBy("a", "m").collect()]
    assert got == [(1, 0), (1, 2), (1, 5), (2, 3)]
    ids = lambda d: sorted(r.id for r in R.sample_rows(d, 10, ["id"], 1).collect())
    assert ids(spark.range(500).repartition(1)) == ids(spark.range(500).repartition(6))
    o = R.overlap(spark.createDataFrame([(1,), (1,), (2,), (None,)], "x long"), "x", spark.createDataFrame([(1,), (None,)], "k long"), "k").first()
    assert (o["values"], o.found, o.overlap) == (2, 1, 0.5)


@pytest.mark.parametrize("family,make", [("normal", lambda r: r.gauss(50, 5)), ("exponential", lambda r: r.expovariate(0.2)), ("uniform", lambda r: r.uniform(3, 9)), ("log_normal", lambda r: r.lognormvariate(1, 0.8)), ("pareto", lambda r: 2 * r.paretovariate(3))])
def test_fits_recover_their_family(spark, family, make):
    rnd = random.Random(7)
    df = spark.createDataFrame([(make(rnd),) for _ in range(4000)], "v double")
    got = fit.goodness(df, ["v"]).first()
    assert got.family == family and got.ks < 0.03 and got.p_value > 0.01


def test_fit_without_variance(spark):
    df = spark.createDataFrame([(3.0, None), (3.0, None)], "a double, b double")
    assert fit.best(fit.sufficient(df, ["a", "b"])).collect() == []


def test_correlations(spark):
    rnd = random.Random(3)
    rows = [(x, 2 * x + 1, rnd.random(), None if rnd.random() < 0.2 else math.exp(x)) for x in (rnd.gauss(0, 1) for _ in range(400))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r.left, r.right): r for r in correlate.pearson(df, ["a", "b", "c", "d"]).collect()}
    assert abs(got[("a", "b")].r - 1) < 1e-9 and got[("a", "b")].p == 0 and abs(got[("a", "c")].r) < 0.15 and got[("a", "d")].n < 400
    assert abs(correlate.spearman(df, "a", "d").first().r - 1) < 1e-9
    assert {(r.left, r.right) for r in correlate.notable(correlate.pearson(df, ["a", "b", "c"])).collect()} == {("a", "b")}
    cat = spark.createDataFrame([(i % 3, (i % 3) * 2, i % 5, None) for i in range(60)], "x long, y long, z long, n long")
    assert abs(correlate.cramers_v(cat, "x", "y").first().v - 1) < 1e-9 and correlate.cramers_v(cat, "x", "z").first().v < 1e-6
    assert correlate.dependency(cat, "y", "x").first().ratio == 1 and correlate.dependency(cat, "z", "x").first().ratio == 0
    assert correlate.tuple_groups([("a", "b"), ("b", "c"), ("x", "y")]) == [["a", "b", "c"], ["x", "y"]]


def test_relations(spark):
    df = spark.createDataFrame([(float(q), 2.5, q * 2.5, 100.0 + q) for q in range(1, 60)], "q double, u double, t double, late double")
    got = {(r.target, r.left, r.op, r.right) for r in correlate.arithmetic(df, ["q", "u", "t"]).collect()}
    assert ("t", "q", "*", "u") in got and ("q", "t", "/", "u") in got
    assert ("q", "late") in {(r.low, r.high) for r in correlate.orderings(df, ["q", "late"]).collect()}
    people = spark.createDataFrame([("ann", "lee", "ann.lee"), ("bob", "ray", "bob.ray")], "f string, l string, u string")
    best = max(correlate.derived_text(people, "u", ["f", "l"]).collect(), key=lambda r: r.share)
    assert (best.left, best.separator, best.right, best.share) == ("f", ".", "l", 1.0)
    assert correlate.grid(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a long, b long"), "a", "b").first().completeness == 0.75


def test_types(spark):
    rows = [(str(i), f"{i}.5", "yes" if i % 2 else "no", f"u{i}@x.org", "2024-01-%02d" % (i % 28 + 1), "ab"[i % 2], f"some text {i}", None) for i in range(300)]
    names = ["i", "f", "b", "e", "d", "c", "t", "n"]
    got = {r.column_name: r.inferred for r in profile.inferred_types(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names)), names).collect()}
    assert got == {"i": "integer", "f": "float", "b": "bool", "e": "email", "d": "date", "c": "category", "t": "text", "n": "text"}


def test_key_names():
    assert keys.looks_like_id("customer_id") and keys.looks_like_id("employeeId") and not keys.looks_like_id("o_orderkey") and keys.looks_like_id("o_orderkey", relaxed=True)
    assert keys.name_score("customer_id", "customer") == 1 and keys.name_score("order_id", "orders") == 0.9 and keys.name_score("custkey", "customer", relaxed=True) == 0.6 and keys.name_score("user_id", "orders") == 0


def test_series(spark):
    rows = [(i, i // 3, float(i % 12) * 10 + 0.01 * i, 1_700_000_000 + i * 60) for i in range(240)]
    df = spark.createDataFrame(rows, "i long, s long, v double, t long").withColumn("t", F.timestamp_seconds("t"))
    assert series.sort_order(df, ["i"], "s").first().direction == "ascending" and series.sort_order(df, ["i"], "v").first().direction == "unsorted"
    assert series.trend(df, ["i"], "i").first().trending and not series.trend(df, ["i"], "v").first().trending
    acf = {r.lag: r.acf for r in series.autocorrelation(df, ["i"], "v", [6, 12]).collect()}
    assert acf[12] > 0.9 and acf[6] < 0.1
    one = df.withColumn("k", F.lit("k"))
    assert series.seasons(one, "k", "i", "v").first().period == 12
    fixed = series.interval_pattern(one, "k", "t").first()
    assert fixed.pattern == "fixed_interval" and fixed.mean_gap == 60
    assert series.time_pattern(np.arange(50) * 60.0)[0] == "fixed_interval" and series.time_pattern(np.array([1.0]))[0] == "irregular"
    assert series.season_length(np.ones(50)) == 0 and series.calendar_pattern(df.limit(0), "t").collect() == []


def test_behavior(spark):
    rows = [(a, 1_700_000_000 + i * 3600 * (1 + a % 2) + a) for a in range(12) for i in range(30)]
    df = spark.createDataFrame(rows, "a long, t long").withColumn("t", F.timestamp_seconds("t"))
    p = behavior.actor_profiles(df, "a", "t")
    r = p.first()
    assert p.count() == 12 and abs(sum(r[f"h{h}"] for h in range(24)) - 1) < 1e-9
    f = behavior.features(p).toPandas()
    assert abs(f["f1"].mean()) < 1e-9 and len(f.columns) == 34
    seg = behavior.segments(behavior.features(p)).collect()
    assert {s.actor: s.segment for s in seg}.keys() == set(range(12)) and len({s.segment for s in seg if s.actor % 2 == 0} & {s.segment for s in seg if s.actor % 2}) == 0
    ring = spark.createDataFrame([(str(i), str((i + 1) % 5), 1) for i in range(5)] + [(str((i + 1) % 5), str(i), 1) for i in range(5)], "src string, dst string, n long")
    g = behavior.graph_metrics(ring).first()
    assert (g.nodes, g.edges, g.reciprocity, g.clustering) == (5, 10, 1.0, 0.0) and g["class"] == "erdos_renyi"
    assert behavior.actor_score("user_id") == 0.95 and behavior.actor_score("created_by") == 0.85 and behavior.actor_score("price") == 0


def test_clustering_counts_all_sources_and_neighbours(spark):
    rnd = random.Random(5)
    arcs = {(str(rnd.randrange(150)), str(rnd.randrange(150))) for _ in range(1500)} | {("hub", str(i)) for i in range(150)} | {(str(i), "hub") for i in range(0, 150, 3)}
    near: dict = {}
    for a, b in arcs:
        if a != b:
            near.setdefault(a, set()).add(b)
    pairs = [(a, b) for n in near.values() for a in n for b in n if a < b]
    closed = sum((a, b) in arcs or (b, a) in arcs for a, b in pairs)
    g = behavior.graph_metrics(spark.createDataFrame([(a, b, 1) for a, b in arcs], "src string, dst string, n long")).first()
    assert g.edges == len(arcs) and abs(g.clustering - closed / len(pairs)) < 1e-12
    loops = spark.createDataFrame([("a", "a", 1), ("a", "b", 1)], "src string, dst string, n long")
    assert behavior.graph_metrics(loops).first().clustering == 0.0


def test_state_is_mergeable_and_idempotent(spark):
    rnd = random.Random(1)
    rows = [(i % 4, rnd.gauss(5, 2) if rnd.random() < 0.9 else None, i % 10) for i in range(800)]
    df = spark.createDataFrame(rows, "c int, x double, k long")
    parts = state.partials(df, "c", "t")
    again = state.ingest(state.ingest(None, parts.where("chunk in ('0','1')")), parts)
    whole, twice = ({r.column_name: r for r in state.merged(p).collect()} for p in (parts, again))
    xs = [x for _, x, _ in rows if x is not None]
    assert whole == twice and abs(whole["x"].mean - mean(xs)) < 1e-9 and abs(whole["x"].std - stdev(xs)) < 1e-9 and whole["k"].distinct == 10
    r = state.correlations(state.comoments(df, "c", ["x", "k"])).first().r
    pair = [(x, k) for _, x, k in rows if x is not None]
    assert abs(r - np.corrcoef(*zip(*pair, strict=True))[0, 1]) < 1e-9
    assert state.widened(["int", "double"]) == "double" and state.widened(["int", "string"]) == "string"
    assert state.coverage(parts, ("t", "k"), ("t", "k"), 1.0).first().kept


def test_learned_model_generates_its_like(spark):
    from fathom.operators import blueprint
    from fathom.operators.generate import engine
    from fathom.operators.learn import assemble

    rnd = random.Random(5)
    parent = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "id long, grade string")
    child = spark.createDataFrame([(i, rnd.randrange(60), rnd.gauss(100, 15), None if rnd.random() < 0.3 else f"a{i}@x.org", [1]) for i in range(3000)], "id long, parent_id long, score double, mail string, tags array<long>")
    links = [{"name": "l", "from_table": "child", "foreign_key": "parent_id", "to_table": "parent", "to_column": "id"}]
    m = assemble.learn_model({"parent": parent, "child": child}, {"parent": "id", "child": "id"}, links)
    assert blueprint.validate(m) == []
    kinds = {f: s["generator"]["type"] for f, s in m["tables"]["child"]["fields"].items()}
    assert kinds == {"id": "sequence", "parent_id": "fk", "score": "distribution", "mail": "faker"} and m["tables"]["child"]["fields"]["score"]["generator"]["family"] == "normal"
    t = engine.generate(spark, m)
    assert t["child"].count() == 3000 and R.overlap(t["child"], "parent_id", t["parent"], "id").first().overlap == 1
    s = t["child"].agg(F.avg("score"), F.stddev("score"), F.avg(F.col("mail").isNull().cast("int"))).first()
    assert abs(s[0] - 100) < 2 and abs(s[1] - 15) < 1.5 and abs(s[2] - 0.3) < 0.05
    assert assemble.geographic(["city", "x", "zip_code"]) == ["city", "zip_code"] and assemble.geographic(["city"]) == []
    empty = assemble.learn_table(parent.limit(0), "id")
    assert empty["count"] == 0
