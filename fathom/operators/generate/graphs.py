"""Graphs, hierarchies and threads as tables of edges or parents, each edge a function of hashed row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.rng import Rng
from fathom.operators.relational import prefix_sums
from fathom.session import checkpoint


def _rows(spark: SparkSession, n: int, name: str = "row") -> DataFrame:
    return spark.range(n, numPartitions=max(1, -(-n // 1_000_000))).withColumnRenamed("id", name)


def tree(spark: SparkSession, n: int, branching: int = 3) -> DataFrame:
    """(node, parent): the complete tree with a branching factor; node 0 is the root."""
    return _rows(spark, n, "node").withColumn("parent", F.when(F.col("node") > 0, F.floor((F.col("node") - 1) / branching).cast("long")))


def parent_of(node: Column, n: int, rng: Rng, max_depth: int) -> tuple[Column, Column]:
    """(parent, depth) of a node of an acyclic hierarchy of bounded depth. Nodes get a level with room growing geometrically, and a parent among
    those of the level above, so no iteration is needed."""
    widths, left, w = [], n, 1
    grow = max(2, math.ceil(n ** (1 / max_depth)))
    for level in range(max_depth + 1):
        take = left if level == max_depth else min(left, w)
        widths.append(take)
        left, w = left - take, w * grow
    starts = [sum(widths[:i]) for i in range(len(widths))]
    depth, parent = F.lit(0), F.lit(None).cast("long")
    for level in range(1, max_depth + 1):
        if widths[level]:
            depth = F.when(node >= starts[level], level).otherwise(depth)
            parent = F.when(node >= starts[level], F.lit(starts[level - 1]) + rng.integer(0, widths[level - 1] - 1, "parent")).otherwise(parent)
    return parent, depth


def random_tree(spark: SparkSession, n: int, seed: int, max_depth: int = 5) -> DataFrame:
    """(node, parent, depth) of all nodes, by parent_of."""
    parent, depth = parent_of(F.col("node"), n, Rng(seed, "hierarchy", F.col("node")), max_depth)
    return _rows(spark, n, "node").select("node", parent.alias("parent"), depth.alias("depth"))


def complete(spark: SparkSession, n: int) -> DataFrame:
    """(src, dst) of all ordered pairs: the result itself has n*(n-1) rows, numbered directly."""
    i = F.col("row")
    src = F.floor(i / (n - 1)).cast("long")
    rest = i % (n - 1)
    return _rows(spark, n * (n - 1)).select(src.alias("src"), F.when(rest >= src, rest + 1).otherwise(rest).alias("dst"))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    """(src, dst) directed, each present with probability p: a node's out-degree is binomial, and targets
    are hashed, so the work follows the number of edges and not of pairs."""
    from fathom.operators.generate.distributions import distribution

    rng = Rng(seed, "erdos_renyi", F.col("src"))
    degree = distribution(rng, "binomial", {"n": n - 1, "p": p}, "degree")
    slots = _rows(spark, n, "src").withColumn("k", F.greatest(F.lit(0), degree.cast("int"))).where("k > 0").select("src", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("slot"))
    target = Rng(seed, "erdos_renyi_target", F.concat_ws(":", "src", "slot")).integer(0, n - 2, "dst")
    return slots.select("src", F.when(target >= F.col("src"), target + 1).otherwise(target).alias("dst")).distinct()


def small_world(spark: SparkSession, n: int, k: int, beta: float, seed: int) -> DataFrame:
    """(src, dst) of a ring where each node links to its k/2 followers, rewired with probability beta."""
    half = k // 2
    i = F.col("row")
    src, hop = F.floor(i / half).cast("long"), i % half + 1
    rng = Rng(seed, "small_world", i)
    other = F.pmod(src + rng.integer(1, n - 1, "far"), F.lit(n))
    return _rows(spark, n * half).select(src.alias("src"), F.when(rng.uniform("rewire") < beta, other).otherwise(F.pmod(src + hop, F.lit(n))).alias("dst")).where("src <> dst").distinct()


def scale_free(spark: SparkSession, n: int, m: int, seed: int) -> DataFrame:
    """(src, dst) with preferential attachment by the copy model: edge e of node e//m points to a uniform earlier edge slot, and takes that edge's
    source or, as likely, what it points to. Pointers are followed for all edges at once, until none is left: every step halves
    them, and a pointer always goes to an earlier node, so the steps end."""
    e = F.col("e")
    rng = Rng(seed, "scale_free", e)
    src = F.floor(e / m).cast("long")
    edges = _rows(spark, n * m, "e").where(src > 0).select("e", src.alias("src"), F.floor(rng.uniform("pick") * (src * m)).cast("long").alias("at"), (rng.uniform("copy") < 0.5).alias("copy"))
    edges = checkpoint(edges)
    todo, done = edges.select("e", "src", "at", "copy"), None
    while True:
        final = todo.where(~F.col("copy") | (F.col("at") < m)).select("src", F.floor(F.col("at") / m).cast("long").alias("dst"))
        done = final if done is None else done.unionByName(final)
        nxt = edges.select(F.col("e").alias("at"), F.col("at").alias("at2"), F.col("copy").alias("copy2"))
        todo = checkpoint(todo.where(F.col("copy") & (F.col("at") >= m)).join(nxt, "at").select("e", "src", F.col("at2").alias("at"), F.col("copy2").alias("copy")))
        if todo.isEmpty():
            return done.where("src <> dst").distinct()


def blocks(spark: SparkSession, n: int, groups: int, inside: float, outside: float, seed: int) -> DataFrame:
    """(src, dst) of a block model: targets of the own group with rate ``inside``, of others with ``outside``; groups are row number modulo."""
    own = n // groups
    per, out = max(0, round(own * inside)), max(0, round((n - own) * outside))
    slots = _rows(spark, n, "src").select("src", F.explode(F.sequence(F.lit(1), F.lit(max(1, per + out)))).alias("slot"))
    rng = Rng(seed, "blocks", F.concat_ws(":", "src", "slot"))
    group = F.col("src") % groups
    same = rng.integer(0, max(0, own - 1), "in") * groups + group
    shift = F.pmod(group + rng.integer(1, max(1, groups - 1), "g"), F.lit(groups))
    other = rng.integer(0, max(0, own - 1), "out") * groups + shift
    return slots.select("src", F.when(F.col("slot") <= per, same).otherwise(other).alias("dst")).where("src <> dst").distinct()


def configuration(spark: SparkSession, n: int, mean: float, seed: int, power: float | None = None) -> DataFrame:
    """(src, dst): degrees are drawn, then stubs are paired in hashed order, the first half with the second."""
    from fathom.operators.generate.distributions import distribution
    from fathom.operators.relational import row_index

    rng = Rng(seed, "configuration", F.col("node"))
    degree = distribution(rng, "pareto", {"scale": 1.0, "shape": power}, "d", round_=True) if power else distribution(rng, "poisson", {"lambda": mean}, "d")
    stubs = _rows(spark, n, "node").withColumn("k", F.least(F.lit(n), degree.cast("long"))).where("k > 0").select("node", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("s"))
    order = row_index(stubs.withColumn("h", F.xxhash64("node", "s", F.lit(seed))), ["h", "node", "s"], "i")
    half = F.floor(F.col("i") / 2)
    left = order.where("i % 2 = 0").select(half.alias("p"), F.col("node").alias("src"))
    right = order.where("i % 2 = 1").select(half.alias("p"), F.col("node").alias("dst"))
    return left.join(right, "p").select("src", "dst").where("src <> dst").distinct()


def reciprocated(edges: DataFrame, share: float, seed: int) -> DataFrame:
    """Edges with the reverse of a share of them added."""
    rng = Rng(seed, "reciprocity", F.concat_ws(":", "src", "dst"))
    return edges.unionByName(edges.where(rng.uniform("back") < share).select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def lateral_hierarchy(spark: SparkSession, n: int, depth: int, seed: int, lateral: float = 0.1) -> DataFrame:
    """(src, dst): tree edges with a branching of n^(1/depth), and a few between neighbours of a level."""
    b = max(2, math.ceil(n ** (1 / depth)))
    t = tree(spark, n, b).where("parent is not null").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    rng = Rng(seed, "lateral", F.col("src"))
    side = t.where((rng.uniform("side") < lateral) & (F.col("src") + 1 < n)).select("src", (F.col("src") + 1).alias("dst"))
    return t.unionByName(side)


def interactions(edges: DataFrame, mean: float, seed: int) -> DataFrame:
    """(src, dst, seq): events along edges, a Poisson number of them for each."""
    from fathom.operators.generate.distributions import distribution

    rng = Rng(seed, "interactions", F.concat_ws(":", "src", "dst"))
    return edges.withColumn("k", distribution(rng, "poisson", {"lambda": mean}, "n").cast("int")).where("k > 0").select("src", "dst", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("seq"))


def neighbour_of(df: DataFrame, rng: Rng, actor: str, edges: DataFrame, name: str) -> DataFrame:
    """A neighbour of each row's actor, by the place its hash has among the actor's numbered edges; null where there is none. Numbering is a distributed
    scan, so that an actor with most of the edges is not gathered, and rows meet it on (actor, number)."""
    numbered = prefix_sums(edges.select("src", "dst").distinct(), ["dst"], F.lit(1).cast("long"), ["src"], "__n").select(F.col("src").alias(actor), (F.col("__n") - 1).cast("int").alias("__n"), F.col("dst").alias(name))
    degrees = edges.select("src", "dst").distinct().groupBy(F.col("src").alias(actor)).agg(F.count(F.lit(1)).alias("__d"))
    drawn = df.join(degrees, actor, "left").withColumn("__n", F.pmod(rng.bits(name), F.col("__d")).cast("int"))
    return drawn.join(numbered, [actor, "__n"], "left").drop("__n", "__d")


def threads(df: DataFrame, rng: Rng, row: Column, reply: float, window: int, name: str = "reply_to") -> DataFrame:
    """Adds the row number of an earlier row this one replies to: with probability ``reply``, and by a recency-weighted distance up to ``window``."""
    back = F.ceil(F.pow(rng.uniform("distance"), F.lit(2.0)) * window).cast("long")
    target = row - F.greatest(F.lit(1).cast("long"), back)
    return df.withColumn(name, F.when((rng.uniform("reply") < reply) & (target >= 0), target))


def cap_depth(df: DataFrame, row: str, parent: str, max_depth: int) -> DataFrame:
    """Rows deeper than ``max_depth`` become tops of their own; depths come from tree contraction, whatever the length of threads."""
    from fathom.operators.hierarchy import forest

    deep = forest(df.select(row, parent), row, parent).select(F.col("id").alias(row), F.col("depth").alias("__d"))
    return df.join(deep, row).withColumn(parent, F.when(F.col("__d") % (max_depth + 1) != 0, F.col(parent))).drop("__d")
