import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions.rng import Rng
from fathom.operators import noise
from fathom.operators.generate import columns, engine, graphs, series
from fathom.operators.generate.distributions import FAMILIES, distribution
from fathom.operators.hierarchy import forest
from fathom.plans.model_queries import MODEL

MOMENTS = {  # family: parameters, mean, standard deviation
    "uniform": ({"min": 2, "max": 6}, 4, 4 / math.sqrt(12)), "normal": ({"mean": 100, "std_dev": 10}, 100, 10), "log_normal": ({"mu": 0, "sigma": 0.5}, math.exp(0.125), 0.6039), "exponential": ({"lambda": 2}, 0.5, 0.5),
    "bernoulli": ({"p": 0.3}, 0.3, math.sqrt(0.21)), "geometric": ({"p": 0.25}, 3, math.sqrt(12)), "pareto": ({"scale": 1, "shape": 5}, 1.25, math.sqrt(5 / 48)), "weibull": ({"scale": 1, "shape": 2}, 0.8862, 0.4633),
    "triangular": ({"min": 0, "max": 6, "mode": 3}, 3, math.sqrt(1.5)), "poisson": ({"lambda": 4}, 4, 2), "binomial": ({"n": 20, "p": 0.3}, 6, math.sqrt(4.2)), "gamma": ({"shape": 0.5, "scale": 2}, 1, math.sqrt(2)),
    "beta": ({"alpha": 2, "beta": 2}, 0.5, math.sqrt(0.05)), "chi_squared": ({"k": 4}, 4, math.sqrt(8)), "student_t": ({"n": 8}, 0, math.sqrt(8 / 6)),
}


def test_moments(spark):
    rng = Rng(1, "m", F.col("id"))
    names = list(MOMENTS)
    df = spark.range(60_000).select(*[distribution(rng, f, MOMENTS[f][0], f).alias(f) for f in names])
    got = df.agg(*[a for f in names for a in (F.avg(f), F.stddev_pop(f))]).first()
    for i, f in enumerate(names):
        _, mean, std = MOMENTS[f]
        assert abs(got[2 * i] - mean) < 0.05 * max(1, abs(mean)) and abs(got[2 * i + 1] - std) < 0.15 * std, f


def test_all_families_and_bad_parameters(spark):
    rng = Rng(1, "m", F.col("id"))
    row = spark.range(5).select(*[distribution(rng, f, {}, f).alias(f) for f in FAMILIES]).collect()
    assert all(x is not None for r in row for x in r)
    for f, p in (("normal", {"std_dev": -1}), ("nope", {}), ("poisson", {"lambda": 0})):
        with pytest.raises(ValueError):
            distribution(rng, f, p, "x")


def test_same_seed_same_rows_on_any_partitions(spark):
    a = engine.generate(spark, MODEL)["sale"]
    rows = lambda d: Counter(map(tuple, d.collect()))
    assert rows(a) == rows(engine.generate(spark, MODEL)["sale"].repartition(3)) and rows(a) != rows(engine.generate(spark, MODEL | {"seed": 43})["sale"])


def test_references_exist_and_nulls_hit_their_rate(spark):
    t = engine.generate(spark, MODEL)
    assert t["sale"].join(t["shop"], t["sale"]["shop_id"] == t["shop"]["id"], "left_anti").count() == 0
    rate = t["sale"].agg(F.avg(F.col("price").isNull().cast("int"))).first()[0]
    assert abs(rate - 0.1) < 0.02
    bad = t["sale"].where(F.abs(F.col("total") - F.col("quantity") * F.col("price")) > 0.006).count()
    assert bad == 0


def test_texts_and_check_digits(spark):
    ctx = columns.Context(3, "t", "x", 300)
    df = engine.row_source(spark, 300)
    got = df.select(*[columns.faker(ctx, k).cast("string").alias(k) for k in ("credit_card", "ean13", "iban", "email", "uuid", "ipv4")]).collect()

    def luhn(s):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0

    for r in got:
        assert luhn(r.credit_card) and len(r.credit_card) == 16
        assert sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(r.ean13)) % 10 == 0
        assert int(r.iban[4:] + "1314" + r.iban[2:4]) % 97 == 1
        assert "@example." in r.email and r.uuid[14] == "4" and r.uuid[19] in "89ab"


def test_unique_pattern_sequence_and_selections(spark):
    ctx = columns.Context(3, "t", "x", 5000, parents={"p": columns.Keys(100, 10, 5)})
    df = engine.row_source(spark, 5000).select(columns.unique_int(ctx, 1, 5000).alias("u"), columns.pattern(ctx, r"A\##?-x").alias("p"), columns.sequence(ctx, 1, 1, "N-", 6).alias("s"), *[columns.fk(ctx, "p", m).alias(m) for m in ("uniform", "sequential", "clustered", "zipf")])
    assert df.select("u").distinct().count() == 5000 and df.where("u not between 1 and 5000").count() == 0
    assert df.where(~F.col("p").rlike(r"^[A-Z]#\d[a-z]-x$")).count() == 0 and df.where("s = 'N-000001'").count() == 1
    for m in ("uniform", "sequential", "clustered", "zipf"):
        assert df.where(f"{m} < 10 or {m} > 505 or ({m} - 10) % 5 <> 0").count() == 0, m
    with pytest.raises(ValueError):
        columns.unique_int(ctx, 1, 10)


def test_weighted_pick(spark):
    parents = spark.createDataFrame([(1, 1.0), (2, 9.0), (3, 0.0), (4, None)], "k long, w double")
    rows = engine.row_source(spark, 4000).withColumn("u", Rng(1, "w", F.col("__row")).uniform("u"))
    got = {r.k: r["count"] for r in columns.weighted_pick(rows, "u", parents, "k", "w", "k").groupBy("k").count().collect()}
    assert sum(got.values()) == 4000 and set(got) == {1, 2} and abs(got[1] / 4000 - 0.1) < 0.03


def test_copulas_and_correlation(spark):
    rng = Rng(2, "c", F.col("__row"))
    u, t = rng.uniform("u") + 1e-12, rng.uniform("t") + 1e-12
    g = series.gumbel(rng, 2.0, "g")
    df = engine.row_source(spark, 20_000).select(u.alias("u"), series.clayton(u, t, 2.0).alias("c"), series.frank(u, t, 5.74).alias("f"), g[0].alias("g1"), g[1].alias("g2"))
    r = df.agg(F.corr("u", "c"), F.corr("u", "f"), F.corr("g1", "g2"), F.min("c"), F.max("f"), F.avg("g1")).first()
    assert all(0.6 < x < 0.75 for x in r[:3]) and r[3] >= 0 and r[4] <= 1 and abs(r[5] - 0.5) < 0.02
    base = spark.range(4000).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 89).cast("double").alias("b"))
    out = series.gaussian_copula(base, Rng(1, "g", F.col("id")), "id", ["a", "b"], [[1, 0.7], [0.7, 1]])
    assert abs(out.stat.corr("a", "b") - 0.69) < 0.05 and Counter(r.a for r in out.collect()) == Counter(r.a for r in base.collect())
    with pytest.raises(np.linalg.LinAlgError):
        series.cholesky([[1, 1.2], [1.2, 1]])
    z = series.correlated(base, Rng(1, "g", F.col("id")), "a", 0.6, 10, 2, "z")
    assert abs(z.stat.corr("a", "z") - 0.6) < 0.05


def test_streams_and_recurrence(spark):
    rows = engine.row_source(spark, 3000).withColumns({"s": F.col("__row") % 3, "step": F.floor(F.col("__row") / 3)})
    rng = Rng(1, "e", F.col("__row"))
    ev = series.event_stream(rows, rng, "s", "step", 0.5)
    span = ev.groupBy("s").agg(((F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))) / 1000 / F.count("*")).alias("gap")).collect()
    assert all(abs(r.gap - 2) < 0.3 for r in span)
    thinned = series.event_stream(rows, rng, "s", "step", 0.5, profile=[0.5] * 24)
    assert thinned.count() == 3000
    ar = series.recurrence(rows, rng, "s", "step", ar=[0.9])
    v = [r.value for r in ar.where("s = 0").orderBy("step").collect()]
    assert 0.8 < np.corrcoef(v[1:], v[:-1])[0, 1] < 0.97


def test_graphs(spark):
    n = 600
    for e in (graphs.erdos_renyi(spark, n, 0.01, 1), graphs.small_world(spark, n, 4, 0.2, 1), graphs.scale_free(spark, n, 2, 1), graphs.blocks(spark, n, 3, 0.02, 0.001, 1), graphs.configuration(spark, n, 3.0, 1)):
        assert e.where("src = dst or src not between 0 and 599 or dst not between 0 and 599").count() == 0 and e.count() > n / 2
    degrees = [r["count"] for r in graphs.scale_free(spark, n, 2, 1).groupBy("dst").count().collect()]
    assert max(degrees) > 8 * sum(degrees) / n
    assert graphs.complete(spark, 7).distinct().count() == 42
    t = graphs.random_tree(spark, n, 1, max_depth=4)
    solved = {r.id: r.depth for r in forest(t, "node", "parent").collect()}
    assert solved == {r.node: r.depth for r in t.collect()} and max(solved.values()) <= 4
    ring = graphs.small_world(spark, n, 2, 0.0, 1)
    rows = spark.range(50).select((F.col("id") + 0).alias("src"))
    picked = graphs.neighbour_of(rows, Rng(1, "n", F.col("src")), "src", ring, "friend").collect()
    assert all(r.friend == (r.src + 1) % n for r in picked)


def test_threads_are_capped(spark):
    rows = engine.row_source(spark, 300)
    made = graphs.cap_depth(graphs.threads(rows, Rng(2, "t", F.col("__row")), F.col("__row"), 0.95, 3), "__row", "reply_to", 4)
    assert max(r.depth for r in forest(made, "__row", "reply_to").collect()) <= 4 and made.count() == 300


def test_constraints_and_layers(spark):
    df = spark.createDataFrame([(5.0, 1.0), (None, 1.0), (-9.0, 50.0)], "a double, b double")
    got = engine.enforce(engine.enforce(df, {"range": ["b", 2.0, 9.0]}), {"ordered": ["a", "b"]}).collect()
    assert [tuple(r) for r in got] == [(2.0, 5.0), (None, 2.0), (-9.0, 9.0)]
    assert engine.layers({"a": {"generator": {"type": "derived", "expression": "${b}"}}, "b": {}}) == [["b"], ["a"]]


# --- noise


@pytest.fixture(scope="module")
def clean(spark):
    rows = [(i, float(i % 50), f"name {i}", f"u{i}@example.com", None if i % 10 == 0 else i % 7) for i in range(1000)]
    return spark.createDataFrame(rows, "id long, x double, s string, mail string, ref long")


def test_perturbators(spark, clean):
    s = noise.Scope("id", 0.3, 1)
    assert 200 < noise.inject_nulls(clean, ["x"], s).where("x is null").count() < 400
    typo = noise.inject_typos(clean, ["s"], s).join(clean.select("id", F.col("s").alias("o")), "id")
    assert typo.where("s <> o and levenshtein(s, o) > 2").count() == 0 and typo.where("s <> o").count() > 200
    assert noise.inject_outliers(clean, ["x"], s).where("x < -50 or x > 100").count() > 200
    assert noise.append_duplicates(clean, s).count() > 1200
    assert noise.truncate_texts(clean, ["s"], s).where("length(s) = 0").count() == 0
    assert noise.violate_keys(clean, ["ref"], s).where("ref > 6").count() > 200
    assert noise.corrupt_formats(clean, ["mail"], s).where("mail not like '%@%'").count() > 200
    swapped = noise.swap_values(clean, "s", s)
    assert Counter(r.s for r in swapped.collect()) == Counter(r.s for r in clean.collect()) and swapped.join(clean, ["id", "s"]).count() < 800
    assert noise.drift_values(clean, ["x"], noise.Scope("id", 1.0), 2.0).where("id = 10").first().x == 30.0
    g = noise.add_gaussian(clean, ["ref"], s, 3.0)
    assert g.schema == clean.schema


def test_scope_reads_original_rows_and_schema_stays(spark, clean):
    p = noise.Pipeline("id", 3).add("null", rate=1.0, columns=["s"], where="${x} < 10").add("gaussian", rate=1.0, columns=["x"], sigma=1000.0).add("duplicate", rate=0.1)
    out = p.apply(clean)
    assert out.dtypes == clean.dtypes
    assert out.where("s is null").select("id").distinct().count() == clean.where("x < 10").count()
    with pytest.raises(ValueError):
        p.add("nope")
    empty = noise.Pipeline("id", 3).add("swap", column="s").add("outlier", columns=["x"]).apply(clean.limit(0))
    assert empty.count() == 0
