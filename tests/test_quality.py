import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from fathom.functions.buckets import bucket_of, value_of
from fathom.operators import quality as Q
from fathom.plans import data_problems

SCHEMA = "load_id int, name string, x double, k long, mask string, n long, rows long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "m", 1, 2) for r in rows], SCHEMA)


def test_masks(spark):
    rows = [("Ab-12",), ("",), (None,), ("a1b2c3d4",), ("Zoë 9",), ("x" * 100_000,), ("MIXED case 77",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(Q.mask(F.col("v"))).collect()]
    assert got == ["Aa-9", "", None, "w", "Aau 9", "a", "A a 9"]


def test_departures(spark):
    rows = [(1, "ab", 1.0, 1)] * 50 + [(1, None, 5.0, 2)] * 50 + [(2, "ab", 100.0, i) for i in range(100)] + [(None, "", None, None)] * 10
    stored = [
        {"column_name": "name", "null_rate": 0.02, "empty_string_rate": 0.0, "pattern": "^[a-z]+$", "pattern_rate": 1.0, "weights": {"ab": 1.0}},
        {"column_name": "x", "median": 3.0, "null_rate": None},
        {"column_name": "k", "cardinality_ratio": 0.9},
        {"column_name": "absent", "null_rate": 0.0},
    ]
    got = {(r.column_name, r.load_id, r.metric) for r in Q.departures(frame(spark, rows), "load_id", stored).collect()}
    assert got == {("name", 1, "null_rate"), ("name", None, "empty_string_rate"), ("x", 2, "median"), ("k", 1, "cardinality_ratio"), ("name", None, "weights")}


@pytest.mark.parametrize("values,stored,departs", [([1.0, 9.0], 2.4, True), ([1.0, 9.0], 2.5, False), ([1.0, 3.0, 3.0, 9.0], 6.1, True), ([1.0, 3.0, 3.0, 9.0], 6.0, False), ([5.0], 10.0, False), ([], 1.0, False), ([float("nan"), 5.0], 1.0, True)])
def test_median_limits_are_exact(spark, values, stored, departs):
    clean = [v for v in values if v == v]
    if clean:
        assert (median(clean) > 2 * stored or median(clean) < stored / 2) == departs
    got = Q.departures(frame(spark, [(1, "a", v, 1) for v in values]), "load_id", [{"column_name": "x", "median": stored}]).collect()
    assert bool(got) == departs


def test_profile(spark):
    rnd = random.Random(1)
    rows = [(i % 2, rnd.choice(["a", "b", "", None]), rnd.random() * 100 - 20, i) for i in range(400)]
    got = {(r.load_id, r.column_name): r for r in Q.profile(frame(spark, rows), "load_id", {"name": "^a$"}).collect()}
    mine = [r for r in rows if r[0] == 1]
    r = got[(1, "name")]
    assert r.row_count == 200 and r.null_rate == sum(x[1] is None for x in mine) / 200 and r.distinct_count == 3
    assert r.pattern_rate == sum(x[1] == "a" for x in mine) / sum(x[1] in ("a", "b") for x in mine)
    low = sorted(x[2] for x in mine)[99]
    assert abs(got[(1, "x")].median - low) <= 0.005001 * abs(low)
    assert Q.profile(frame(spark, []), "load_id").collect() == []


def test_divergence(spark):
    rows = [(1, "ab", 0.0, 0)] * 90 + [(2, "ab", 0.0, 0)] * 90 + [(3, "12", 0.0, 0)] * 20
    got = {r.load_id: (r.values, round(r.divergence, 3), r.divergence_previous) for r in Q.mask_divergence(Q.mask_counts(frame(spark, rows), "load_id", ["name"])).collect()}
    assert got == {1: (90, 0.1, None), 2: (90, 0.1, 0.0), 3: (20, 0.9, 1.0)}


def test_masks_are_their_steps(spark):
    import re

    rnd = random.Random(2)
    values = ["".join(rnd.choice("ab Zq9\t\n-.é世x4") for _ in range(rnd.randrange(12))) for _ in range(300)]

    def steps(v):
        for p, m in Q.MASK_STEPS:
            v = re.sub(p, m, v)
        return v

    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", Q.mask(F.col("v"))).collect()
    assert all(m == steps(v) for v, m in got)


PATTERNS = ["^[A-Z]+$", "^/[a-z0-9/_?=&.-]*$", "^[A-Za-z]+/[0-9]+[.][0-9]+", "^[+][0-9]{2} [0-9]{3}$", "^[0-9]{5}$", "^[a-z]+[a-z0-9]+$", "^[a-z]*-?[a-z]+$", "^[a-z]$", "^[a-z-_]+$", "^[0-9]?[A-Z]{2,3}$"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_on_masks_hold_of_the_same_values(spark, pattern):
    kind, on_mask = Q.mask_pattern(pattern)
    rnd = random.Random(pattern)
    values = ["".join(rnd.choice("abAB12/-_.+ \t\n") for _ in range(rnd.randrange(9))) for _ in range(800)] + ["AB", "/a1.b", "Ab/12.3", "+12 345", "+12\t345", "12345", "aa", "a1", "a-b", "AB\n", "1AB", "é"]
    masked = {"runs": Q.runs, "classes": Q.classes}[kind](F.col("v"))
    bad = spark.createDataFrame([(v,) for v in values], "v string").where(F.col("v").rlike(pattern) != masked.rlike(on_mask)).collect()
    assert bad == []


@pytest.mark.parametrize("pattern", ["^[0-9a-f]{16}$", "^a+$", "abc", "^.+$", "^[^x]+$", "^(ab)+$", r"^\d+$", r"^[\w]+$", "^a|b$", None])
def test_patterns_that_masks_do_not_decide(pattern):
    assert Q.generaliser(pattern) == ("any", None)


def test_dominant_and_rare(spark):
    rows = [(1, "ab", 1.0, i) for i in range(300)] + [(2, "12", 1.0, 300), (None, "", -1.0, 301), (2, None, None, 302)]
    df = frame(spark, rows)
    top = {(r.column_name, r["mask"], r.n, r["rank"]) for r in Q.dominant_masks(Q.mask_counts(df, "load_id", ["name", "x"])).collect()}
    assert top == {("name", "a", 300, 1), ("x", "9", 301, 1)}
    got = {(r.load_id, r.row_key, r.column_name, r.value, r["mask"]) for r in Q.violations(df, "load_id", "k", ["name", "x"]).collect()}
    assert got == {(2, 300, "name", "12", "9"), (None, 301, "x", "-1.0", "-9")}
    assert Q.violations(df.limit(0), "load_id", "k", ["name", "x"]).collect() == []


def test_mask_report_keeps_null_loads(spark):
    rows = [(1, "ab", 0.5, 0)] * 300 + [(None, "ab", 0.5, 0)] * 7 + [(None, "12", -1.0, 0)]
    counts = Q.mask_counts(frame(spark, rows), "load_id", ["name", "x"])
    got = {(r.column_name, r.load_id, r.mask): (r.n, r.is_dominant, r.is_rare) for r in Q.mask_report(counts).collect()}
    assert got == {("name", 1, "a"): (300, True, False), ("name", None, "a"): (7, True, False), ("name", None, "9"): (1, False, True), ("x", 1, "9.9"): (300, True, False), ("x", None, "9.9"): (7, True, False), ("x", None, "-9"): (1, False, True)}


def test_masks_cover_every_column(spark, sf):
    tables = {n: data_problems.table(spark, sf, n) for n in ("requests", "customers")}
    want = {(n, c) for n, df in tables.items() for c in df.columns if c != "load_id" and df.where(F.col(c).isNotNull()).count()}
    r = tables["requests"]
    marked = r.where("response_time_ms < 0 and response_time_ms = floor(response_time_ms)").count()
    masks, report = data_problems.p4_masks(spark, sf).collect(), data_problems.p4_mask_report(spark, sf).collect()
    assert {(m.table_name, m.column_name) for m in masks} == {(m.table_name, m.column_name) for m in report} == want
    assert marked and sum(m.n for m in report if m.column_name == "response_time_ms" and m.mask == "-9") == marked
    assert sum(m.n for m in report if m.is_rare) == sum(m.rare_rows for m in masks)


def test_buckets_keep_their_error(spark):
    values = [1e-300, -1e300, 3.7, -3.7, 0.0, 1.7976931348623157e308, float("inf"), None, float("nan"), 123456.789]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_of(bucket_of(F.col("v"), 0.01), 0.01)).collect()
    for v, e in got:
        if v is None or v != v:
            assert e is None
        elif abs(v) != float("inf"):
            assert abs(e - v) <= 0.0100001 * abs(v)
