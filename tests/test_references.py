from datetime import datetime as dt

import pytest

from fathom.operators import references as R

CHILD = "id long, ref long, loaded_at timestamp_ntz, arrived string, n long, key string"
PARENT = "k long, loaded_at timestamp_ntz, deleted_at timestamp_ntz, t string, period string"
D = [dt(2024, m, 1) for m in range(1, 13)]


def rows(spark, child, parent, **o):
    c = spark.createDataFrame([(*r, "x", 1, "y") for r in child], CHILD)
    p = spark.createDataFrame([(*r, "x", "y") for r in parent], PARENT)
    return sorted((r.child_key, r.reference, r.reason) for r in R.orphan_rows(c, "ref", "id", "loaded_at", p, "k", "loaded_at", "deleted_at", **o).collect())


@pytest.mark.parametrize("max_heavy", [1, 2, 1000])
def test_missing_later_deleted_and_live(spark, max_heavy):
    parent = [(1, D[2], None), (1, D[1], None), (2, D[0], D[4]), (3, D[0], None), (None, D[0], None)]
    child = [(10, 1, D[0]), (11, 1, D[1]), (12, 2, D[3]), (13, 2, D[4]), (14, 9, D[5]), (15, None, D[5]), (16, 0, D[5]), (17, -3, D[5]), (18, 3, D[5]), (14, 9, D[5]), (19, 9, None), (20, 3, None)]
    want = [(10, 1, "later"), (13, 2, "deleted"), (14, 9, "missing"), (14, 9, "missing"), (16, 0, "missing"), (17, -3, "missing"), (19, 9, "missing")]
    assert rows(spark, child, parent, max_heavy=max_heavy) == want


def test_hot_key_and_mixed_period(spark):
    parent = [(1, datetime_at(2024, 1, 10), datetime_at(2024, 1, 20))]
    child = [(i, 1, datetime_at(2024, 1, 1 + i)) for i in range(30)]
    got = rows(spark, child, parent, max_heavy=1)
    assert {k for k, _, r in got if r == "later"} == set(range(9)) and {k for k, _, r in got if r == "deleted"} == set(range(19, 30))


def datetime_at(y, m, d):
    return dt(y, m, d)


def test_empty_tables(spark):
    assert rows(spark, [], []) == []
    assert rows(spark, [(1, 5, D[0])], []) == [(1, 5, "missing")]


def test_latest_rows_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, D[0], 5), (1, D[1], None), (1, D[1], 7), (None, D[1], 7), (2, None, 1)], "id long, t timestamp_ntz, v long")
    assert sorted((r.id, r.v) for r in R.latest_rows(df, "id", "t").collect()) == [(1, 7), (2, 1)]


def test_counts(spark):
    c = spark.createDataFrame([(1, 5, D[0]), (2, 5, D[0])], "id long, ref long, loaded_at timestamp_ntz")
    p = spark.createDataFrame([], "k long, loaded_at timestamp_ntz")
    found = R.orphans_of({"c": c, "p": p}, [{"from_table": "c", "foreign_key": "ref", "to_table": "p", "to_column": "k"}], {"c": "id"})
    r = R.orphan_counts(found).collect()[0]
    assert (r.child_table, r.period, r.orphans, r.missing_rows, r.later_rows) == ("c", "2024-01", 2, 2, 0)
