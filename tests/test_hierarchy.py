import random

import pytest

from fathom.operators import hierarchy as H


def brute(links):
    parent = dict(links)
    out = {}
    for x in parent:
        trail, at = [x], x
        while True:
            p = parent.get(at)
            if p is None or p not in parent:
                out[x] = (trail[-1], len(trail) - 1, list(reversed(trail)), None, False)
                break
            if p in trail:
                ring = trail[trail.index(p) :]
                out[x] = (None, None, None, min(ring), x in ring)
                break
            trail.append(p)
            at = p
    return out


def check(spark, links):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in links], "id long, parent long, up string, trail int")
    got = {r.id: (r.root, r.depth, list(r.trail) if r.cycle_id is None else None, r.cycle_id, r.on_cycle) for r in H.forest(df, "id", "parent").collect()}
    assert got == brute(links)
    want = {k: (v[0], v[1], v[3]) for k, v in got.items()}
    for local in (3, 10_000):  # contracted nearly to the end, and followed in one task
        assert {r.id: (r.root, r.depth, r.cycle_id) for r in H.roots(df, "id", "parent", local=local).collect()} == want
    assert {r.id: r.cycle_id for r in H.roots(df, "id", "parent", circles_only=True, local=0).collect()} == {k: v[2] for k, v in want.items() if v[2] is not None}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    check(spark, [(i, rnd.choice([None, 999, *range(60)])) for i in range(60)])


def test_deep_chain_and_bush(spark):
    check(spark, [(i, i - 1 if i else None) for i in range(200)] + [(1000 + i, 100) for i in range(50)])


def test_circles(spark):
    check(spark, [(1, 1), (2, 3), (3, 2), (4, 5), (5, 6), (6, 4), (7, 6), (8, 7), (9, None), (-1, 0), (0, -1)])


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, None), (2, 1), (2, 1), (3, 77)], "id long, parent long")
    got = {r.id: (r.root, r.depth) for r in H.forest(df, "id", "parent").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (3, 0)}
    assert {r.id: (r.root, r.depth) for r in H.roots(df, "id", "parent").collect()} == got
    assert H.forest(df.limit(0), "id", "parent").collect() == [] and H.roots(df.limit(0), "id", "parent").collect() == []


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4), (5, 4), (6, 5)], "id long, parent long")
    got = sorted(map(tuple, H.descendants(H.forest(df, "id", "parent")).collect()))
    assert got == [(1, 2, 1), (1, 3, 2), (2, 3, 1), (5, 6, 1)]
