import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathom.llm import distinct as D
from fathom.llm import frequent as Q
from fathom.llm import packing as P
from fathom.llm import quantiles as V
from fathom.llm import queries as L

# --- distinct counts


def hashes(n, seed=0):
    return np.unique(D._mix(np.arange(n, dtype=np.uint64) + np.uint64(seed * 10**9 + 1)))


@pytest.mark.parametrize("n", [600, 5000, 200_000])
def test_estimates_lie_within_their_error(n):
    got = [D.estimate(D.pack(hashes(n, s))) for s in range(6)]
    assert all(abs(e / n - 1) < 4 / math.sqrt(D.M - 2) for e, _, _, _ in got)
    assert sum(lo <= n <= hi for _, lo, hi, _ in got) >= 4


def test_merging_in_any_order_is_one_pass():
    h = hashes(4000)
    parts = [D.pack(h[i::7][:k]) for i in range(7) for k in (300, 4000)]
    whole = D.pack(h)
    assert D.merge(iter(parts)) == D.merge(iter(parts[::-1])) == D.merge(iter([whole, whole])) == whole
    few = D.pack(h[:20])
    assert D.estimate(D.merge(iter([few, few])))[0] == 20 and D.estimate(D.pack(np.zeros(0, np.uint64)))[0] == 0


def test_partials_over_groups(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), rnd.choice(["a", "b", None]), rnd.choice([None, *map(str, range(50))]), "x", 1) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g int, method string, who string, sketch string, grouping int").drop("sketch", "grouping")
    parts = D.partials(df.repartition(5), ["who"], ["g", "method"], D.grouping_sets(["g", "method"]))
    got = {(r.grouping, r.g, r.method): r.estimate for r in D.counts(D.merged(parts, ["identifier", "grouping", "g", "method"])).collect()}
    exact = Counter()
    for g, m, w in {(g, m, w) for g, m, w, _, _ in rows if w is not None}:
        exact[("g,method", g, m)] += 1
    for k, n in exact.items():
        assert got[k] == n
    assert got[("all", None, None)] == 50 and len([k for k in got if k[0] == "method"]) == 3
    empty = D.partials(df.limit(0), ["who"], ["g"], [(), ("g",)])
    assert D.merged(empty, ["identifier", "grouping", "g"]).collect() == []


def test_partials_of_loads_combine_to_all_counts(spark, sf):
    keys = ["identifier", "grouping", "day", "server_id", "method"]
    parts = L.p1_partials(spark, sf)
    assert "load_id" in parts.columns and parts.select("load_id").distinct().count() > 1
    got = D.counts(D.merged(parts, keys)).collect()
    want = L.p1_distinct_counts(spark, sf).collect()
    assert len({r.grouping for r in want}) == 8 and Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_large_identifiers_stay_exact(spark):
    df = spark.createDataFrame([(2**62 + i, None if i % 2 else 1) for i in range(100)], "k long, load int")
    got = D.counts(D.merged(D.partials(df, ["k"], [], [()], always=["load"]), ["identifier", "load"])).collect()
    assert sorted((r.load or 0, r.estimate) for r in got) == [(0, 50.0), (1, 50.0)]


# --- percentiles


def test_percentiles_and_combination(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(3), rnd.randrange(4), rnd.choice([0.0, -1.0, rnd.lognormvariate(3, 2), None, float("nan")]), 1) for _ in range(4000)]
    df = spark.createDataFrame(rows, "load int, g int, x double, bucket int")
    loads = V.bucket_counts(df, ["x"], ["load", "g"])
    got = {r.g: r for r in V.percentiles(V.combine(loads, ["g"]), ["g"]).collect()}
    for g in range(4):
        xs = sorted(x for _, k, x, _ in rows if k == g and x is not None and x == x)
        assert got[g].n == len(xs)
        for p in V.PERCENTILES:
            exact = xs[math.floor(p * (len(xs) - 1) / 100 + 0.5)]
            assert abs(got[g][f"p{p}"] - exact) <= 0.0100001 * abs(exact)
    sets = V.combine_sets(loads, ["load", "g"], [("load",), ()])
    assert {r.grouping: r["sum(n)"] for r in sets.groupBy("grouping").agg(F.sum("n")).collect()}["all"] == sum(got[g].n for g in got)
    assert V.percentiles(V.bucket_counts(df.limit(0), ["x"], ["g"]), ["g"]).collect() == []


def test_partials_of_loads_give_the_percentiles_of_days(spark, sf):
    keys = ["server_id", "status_code", "day"]
    rows = L._by_day(spark, sf).select(*keys, "load_id", *L._MEASURES).collect()
    parts = L.p5_partials(spark, sf)
    got = Counter()
    for r in parts.collect():
        got[tuple(r[k] for k in ("load_id", *keys, "column_name"))] += r.n
    assert got == Counter((r.load_id, *[r[k] for k in keys], m) for r in rows for m in L._MEASURES if r[m] is not None)
    days = {(r.day, r.column_name): r for r in V.percentiles(V.combine(parts, ["day"]), ["day"]).collect()}
    values: dict = {}
    for r in rows:
        for m in L._MEASURES:
            if r[m] is not None:
                values.setdefault((r.day, m), []).append(r[m])
    assert days.keys() == values.keys()
    for k, vs in values.items():
        exact = sorted(vs)[math.floor(50 * (len(vs) - 1) / 100 + 0.5)]
        assert days[k].n == len(vs) and abs(days[k].p50 - exact) <= 0.0100001 * abs(exact)


# --- frequent items


def test_summaries_keep_their_bounds():
    rnd = random.Random(2)
    items = [f"i{int(rnd.paretovariate(0.8))}" for _ in range(20_000)]
    k, rows = 50, []
    import pyarrow as pa

    for i in range(8):
        batches = [pa.RecordBatch.from_pydict({"v": items[i::8]})]
        rows += list(Q.summarise(iter(batches), ["v"], k, i))
    merged = Q.merge_summaries(pd.concat(rows, ignore_index=True), k).iloc[0]
    exact, low = Counter(items), dict(zip(merged["items"], merged["counts"], strict=True))
    assert len(low) <= k and merged["n"] == len(items) and merged["deficit"] <= len(items) / (k + 1) * 2
    assert all(low.get(x, 0) <= n <= low.get(x, 0) + merged["deficit"] for x, n in exact.items())


def test_frequent_is_exact_with_ties_nulls_and_long_texts(spark):
    long = "x" * 50_000
    rows = [("a",)] * 40 + [("A",)] * 40 + [(long,)] * 20 + [("",)] * 500 + [(None,)] * 500 + [(f"u{i}",) for i in range(900)]
    df = spark.createDataFrame([(v, v, 1) for (v,) in rows], "v string, item string, count int").repartition(6)
    got = {(r.column_name, r.item): r["count"] for r in Q.frequent(df, ["v", "item"], "0.02").collect()}
    assert got == {(c, i): n for c in ("v", "item") for i, n in (("a", 40), ("A", 40), (long, 20))}
    assert Q.frequent(df.limit(0), ["v"]).collect() == []
    with pytest.raises(ValueError):
        Q.frequent(df, ["v"], "0.001", k=100)
    assert Q.trim(pd.Series([5, 5, 5, 1]), 2)[0].empty and Fraction("0.005") == Fraction(1, 200)


# --- containers


@pytest.mark.parametrize("seed", range(5))
def test_best_filling_is_optimal(seed):
    rnd = random.Random(seed)
    counts = {rnd.randrange(1, 40): rnd.randrange(1, 4) for _ in range(6)}
    room = rnd.randrange(10, 120)
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
    got = P.best_filling(counts, room)
    assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= counts[k] for k, n in got.items())


def test_plan_uses_every_piece_once():
    rnd = random.Random(1)
    h = Counter(min(64, int(rnd.paretovariate(1) * 3)) for _ in range(3000))
    used, boxes = Counter(), 0
    for first, times, pattern in P.plan(dict(h), 64):
        assert first == boxes and sum(k * n for k, n in pattern.items()) <= 64
        boxes += times
        for k, n in pattern.items():
            used[k] += n * times
    assert used == h and boxes - math.ceil(sum(k * n for k, n in h.items()) / 64) <= 2


def test_pack(spark):
    rows = [(1, None), (2, 0), (3, 5), (4, 23), (5, 10), (6, 5), (7, 10), (7, 10), (None, 3)] + [(100 + i, 4) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    got = P.pack(df, 10).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows) + Counter({4: 2})
    used = Counter()
    for r in got:
        if r.tokens:
            used[r.container] += r.tokens
    assert all(n <= 10 for n in used.values()) and all(r.unused == 10 - used[r.container] for r in got if r.tokens)
    assert {(r.doc_id, r.container) for r in got if not r.tokens} == {(1, None), (2, 0)}
    assert sorted((r.start, r.tokens) for r in got if r.doc_id == 4) == [(0, 10), (10, 10), (20, 3)]
    again = P.pack(df.repartition(7), 10).collect()
    assert sorted((r.doc_id or 0, r.piece, r.container or 0) for r in got) == sorted((r.doc_id or 0, r.piece, r.container or 0) for r in again)
    assert P.pack(df.limit(0), 10).collect() == []
    assert {r.doc_id: r.container for r in P.pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, tokens long"), 10).collect()} == {1: 0, 2: None}


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "word " * 30_000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in P.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] is None and got[4] >= 30_000


def test_shared_identifiers_within_bounds():
    h = hashes(40_000, 5)
    inside = 0
    for k in range(20):
        a, b = h[k * 1000 : k * 1000 + 10_000], h[k * 1000 + 7000 : k * 1000 + 15_000]
        n, low, high = D.shared(D.pack(a), D.pack(b))
        inside += low <= 3000 <= high
        assert low <= n <= high
    assert inside >= 17
    few = D.pack(h[:50])
    assert D.shared(few, D.pack(h[40:60])) == (10.0, 10.0, 10.0) and D.shared(few, D.pack(h[:0])) == (0.0, 0.0, 0.0)
    low, high = D.shared(few, D.pack(h[:5000]))[1:]
    assert low <= 50 <= high


def test_registers_alone_and_in_two_steps(spark, monkeypatch):
    """sparse=0 measures small groups by registers too; merging over the tasks in two steps changes nothing."""
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 700).cast("string").alias("who")).repartition(12)
    parts = D.partials(df, ["who"], ["g"], [(), ("g",)], sparse=0)
    keys = ["identifier", "grouping", "g"]
    one = sorted(map(str, D.merged(parts, keys, sparse=0).collect()))
    monkeypatch.setattr(D, "TREE", 4)
    assert sorted(map(str, D.merged(parts, keys, sparse=0).collect())) == one
    got = D.counts(D.merged(parts, keys, sparse=0)).collect()
    assert len(got) == 4 and all(r.relative_error > 0 and abs(r.estimate / 700 - 1) < 0.15 for r in got)


def test_slices_change_nothing_but_who_goes_where(spark):
    counts = spark.createDataFrame([(i, (i * 37) % 300 + 1 if i % 3 else 40) for i in range(3000)], "doc_id long, tokens long")
    one, many = (P.pack(counts, 512, per_slice=n) for n in (10**6, 50))
    assert P.containers(one, 512).count() == P.containers(many, 512).count()
    assert not P.containers(many, 512).where("used > 512 or unused < 0").count() and many.select("doc_id").distinct().count() == 3000
