"""Parent-child links to full hierarchies, by tree contraction.

Every round removes all leaves (rake) and an independent set of the nodes that have exactly one child (compress), so a
forest of n nodes is gone after O(log n) rounds whatever its depth: a chain of a million nodes takes about as many
rounds as a bush. A removed node keeps a record: the node it hung on (``up``) and the nodes between them that went
before it (``via``). The rounds are then undone in reverse, where ``up`` is always resolved already, so one join per
round yields root, depth and path. Because rounds shrink geometrically, the work of all rounds together is linear.

A node is compressed when it has the least hash of itself, its parent and its only child, which never holds for two
neighbours at once; the hash changes with the round. A circle cannot be raked away. Compression reduces it to one node
that is its own parent, whose ``via`` then lists the rest of the circle: that is how circles are exposed.

Each round is cut with a reliable checkpoint, so a lost executor costs one round. Links, paths and circles stay
distributed; the driver sees one row count a round.

``forest`` keeps the nodes between a removed node and its ``up``, from which whole paths follow; their size is nodes times depth. ``roots``
keeps only how many they are and the least of them, so a node stays one row of fixed size: use it where no paths are asked for. There, what is
left of the links when at most ``LOCAL`` nodes are (which is counted) goes to one task, which follows them to their ends; the
result is the same.

Defined cases: a null parent, or one that is no node, ends the way, so its node is a top. A node that is its own parent is
a circle of one. Rows with a null id are ignored; of several rows with one id the greatest parent counts (reduce
versioned rows before, see references.latest_rows). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.session import checkpoint

MAX_ROUNDS = 200
LOCAL = 10_000


def _rank(c: Column | str, round_: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.struct(F.xxhash64(c, F.lit(round_)), c)


def _links(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, up) of each node; ``up`` is null at tops."""
    links = nodes.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{parent_col}`").cast("long").alias("up"))
    links = links.where("id is not null").groupBy("id").agg(F.max("up").alias("up"))
    known = links.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    return links.join(known, "up", "left").select("id", F.when(F.col("there"), F.col("up")).alias("up"))


def _step(active: DataFrame, k: int, over: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """One round: (id, up, via, fate) of the active nodes. ``over`` makes the way past a spliced node of the ways on both sides."""
    kids = active.groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("kids"), F.min("id").alias("kid"))
    seen = active.join(kids, "id", "left")
    unary = (F.col("kids") == 1) & (_rank("id", k) < _rank("up", k)) & (_rank("id", k) < _rank("kid", k))
    seen = seen.select("id", "up", "via", F.when(F.col("kids").isNull(), "raked").when(unary, "spliced").otherwise("kept").alias("fate"))
    gone = seen.where("fate = 'spliced'").select(F.col("id").alias("up"), F.col("up").alias("over"), F.col("via").alias("over_via"))
    lifted = seen.join(gone, "up", "left").select(
        "id",
        F.coalesce("over", "up").alias("up"),
        F.when(F.col("over").isNull(), F.col("via")).otherwise(over(F.col("via"), F.col("up"), F.col("over_via"))).alias("via"),
        "fate",
    )
    return checkpoint(lifted)


def forest(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, root, depth, trail, cycle_id, on_cycle) of each node.

    trail runs from the root down to the node, both included, and depth is 0 at a root. Where the way up ends in a circle, root
    and depth are null, cycle_id is the least id on that circle, and trail starts at one node of the circle.
    """
    active = checkpoint(_links(nodes, id_col, parent_col).select("*", F.array().cast("array<bigint>").alias("via")))
    rounds, ends = [], []
    for k in range(MAX_ROUNDS):
        # tops and contracted circles are done: nothing above them is left to find
        done = F.col("up").isNull() | (F.col("up") == F.col("id"))
        ends.append(active.where(done))
        active = active.where(~done)
        if active.isEmpty():
            break
        lifted = _step(active, k, lambda via, up, over: F.concat(via, F.array(up), over))
        rounds.append(lifted.where("fate <> 'kept'").drop("fate"))
        active = lifted.where("fate = 'kept'").drop("fate")
    else:
        raise RuntimeError(f"links are not contracted after {MAX_ROUNDS} rounds")

    circle = F.col("up").isNotNull()
    solved = reduce(DataFrame.unionByName, ends).select(
        "id",
        F.when(~circle, F.col("id")).alias("root"),
        F.array("id").alias("trail"),
        F.when(circle, F.array_min(F.concat(F.array("id"), "via"))).alias("cycle_id"),
        F.when(circle, F.concat(F.array("id"), "via")).alias("circle"),
    )
    members = solved.select(F.explode("circle").alias("id"), F.lit(True).alias("on_cycle"))
    solved = solved.drop("circle")
    for removed in reversed(rounds):
        anchor = solved.select(F.col("id").alias("up"), "root", F.col("trail").alias("above"), "cycle_id")
        fresh = removed.join(anchor, "up").select("id", "root", F.concat("above", F.reverse("via"), F.array("id")).alias("trail"), "cycle_id")
        solved = solved.unionByName(checkpoint(fresh))
    depth = F.when(F.col("cycle_id").isNull(), F.size("trail") - 1)
    return solved.join(members, "id", "left").select("id", "root", depth.alias("depth"), "trail", "cycle_id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, root, depth, cycle_id) of all the links left, by following each way until a node that is known."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    up = dict(zip(rows["id"], rows["up"], strict=True))
    low = dict(zip(rows["id"], rows["low"], strict=True))
    size = dict(zip(rows["id"], rows["n"], strict=True))
    known: dict[int, tuple] = {}
    for start in up:
        way, place, at = [], {}, start
        while at not in known and at not in place and at in up:
            place[at] = len(way)
            way.append(at)
            at = up[at]
        if at in place:
            circle = way[place[at] :]
            least = min(x for c in circle for x in (c, low[c]) if x == x)
            known |= dict.fromkeys(circle, (None, None, int(least)))
            way = way[: place[at]]
        elif at not in known:
            known[at] = (int(at), 0, None)
        for x in reversed(way):
            root, depth, cycle = known[up[x]]
            known[x] = (root, None if depth is None else depth + 1 + int(size[x]), cycle)
    out = pd.DataFrame([(i, *known[i]) for i in up], columns=["id", "root", "depth", "cycle_id"])
    yield out.astype({"root": "Int64", "depth": "Int64", "cycle_id": "Int64"})


def roots(nodes: DataFrame, id_col: str, parent_col: str, circles_only: bool = False, local: int = LOCAL) -> DataFrame:
    """(id, root, depth, cycle_id) of each node, or of those alone whose way up ends in a circle; as ``forest`` has them, without paths."""
    none = F.struct(F.lit(None).cast("long").alias("low"), F.lit(0).cast("long").alias("n"))
    active = checkpoint(_links(nodes, id_col, parent_col).select("*", none.alias("via")))
    over = lambda via, up, more: F.struct(F.least(via["low"], up, more["low"]).alias("low"), (via["n"] + 1 + more["n"]).alias("n"))
    null = F.lit(None).cast("long")
    rounds, tops, loops = [], [], []
    for k in range(MAX_ROUNDS):
        done = F.col("up").isNull() | (F.col("up") == F.col("id"))
        tops.append(active.where("up is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), null.alias("cycle_id")))
        loops.append(active.where("up = id").select("id", null.alias("root"), null.alias("depth"), F.least("id", "via.low").alias("cycle_id")))
        active = active.where(~done)
        if active.count() <= local:
            break
        lifted = _step(active, k, over)
        rounds.append(lifted.where("fate <> 'kept'").drop("fate"))
        active = lifted.where("fate = 'kept'").drop("fate")
    else:
        raise RuntimeError(f"links are not contracted after {MAX_ROUNDS} rounds")
    loops = reduce(DataFrame.unionByName, loops)
    # ways that are followed in one task end at a top or at a circle contracted before, whose least id they get here
    found = active.select("id", "up", "via.low", "via.n").repartition(1).mapInPandas(_followed, "id long, root long, depth long, cycle_id long")
    found = found.join(loops.select(F.col("id").alias("root"), F.col("cycle_id").alias("before")), "root", "left")
    ended = F.col("before").isNotNull()
    found = found.select("id", F.when(~ended, F.col("root")).alias("root"), F.when(~ended, F.col("depth")).alias("depth"), F.coalesce("cycle_id", "before").alias("cycle_id"))
    ends = [found, loops, *tops]
    solved = reduce(DataFrame.unionByName, ends)
    solved = checkpoint(solved.where("cycle_id is not null") if circles_only else solved)
    for removed in reversed(rounds):
        anchor = solved.select(F.col("id").alias("up"), "root", F.col("depth").alias("above"), "cycle_id")
        fresh = removed.join(anchor, "up").select("id", "root", (F.col("above") + 1 + F.col("via.n")).alias("depth"), "cycle_id")
        solved = solved.unionByName(checkpoint(fresh))
    return solved


def descendants(solved: DataFrame) -> DataFrame:
    """(id, descendant, distance) of every pair where the way up from descendant passes id.

    Nodes on a circle are left out as ancestors: all nodes with the same cycle_id descend from each of them, which the
    cycle_id column of ``forest`` already says once per node.
    """
    pairs = solved.select(
        F.col("id").alias("descendant"), F.size("trail").alias("n"), F.posexplode("trail").alias("pos", "id")
    ).select("id", "descendant", (F.col("n") - 1 - F.col("pos")).alias("distance"))
    circle = solved.where("on_cycle").select("id")
    return pairs.where("distance > 0").join(circle, "id", "left_anti")
