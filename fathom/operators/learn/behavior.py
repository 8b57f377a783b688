"""Actors and how they behave: profiles, features, segments, and the graph of who deals with whom."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import checkpoint


def actor_score(column: str) -> float:
    """How likely a column names an actor."""
    low = column.lower()
    people = ("user", "customer", "client", "member", "account", "employee", "author", "owner", "patient", "student", "driver", "agent", "player", "person")
    if any(low == f"{p}_id" or low.endswith(f"_{p}_id") for p in people):
        return 0.95
    if low.endswith("_by") and low.rsplit("_", 1)[0] in ("created", "updated", "approved", "assigned", "submitted", "reviewed", "posted", "modified"):
        return 0.85
    if low.split("_")[0] in ("sender", "receiver", "recipient"):
        return 0.80
    return 0.70 if any(low in (f"{p}_name", f"{p}_email", f"{p}_code") for p in people) else 0.0


def actor_registry(columns: dict[str, list[str]], relationships: list[dict]) -> list[list[tuple[str, str]]]:
    """The namespaces of actors: (table, column) of all actor columns and of the keys they refer to, those that references connect in one group. Of
    the size of the schema."""
    parent: dict[tuple[str, str], tuple[str, str]] = {(t, c): (t, c) for t, cs in columns.items() for c in cs if actor_score(c) > 0}

    def root(x: tuple[str, str]) -> tuple[str, str]:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in relationships:
        a, b = (r["from_table"], r["foreign_key"]), (r["to_table"], r["to_column"])
        if a in parent or b in parent:
            parent[root(a)] = root(b)
    groups: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for x in sorted(parent):
        groups.setdefault(root(x), []).append(x)
    return sorted(groups.values())


def field_preferences(df: DataFrame, actor: str, columns: list[str]) -> DataFrame:
    """(actor, column_name, value, n, share): the value each actor uses most in each column; of equals the least."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    long = df.where(F.col(actor).isNotNull()).select(F.col(actor).alias("actor"), F.explode(F.array(*cells)).alias("x")).select("actor", "x.*").where("value is not null")
    counts = long.groupBy("actor", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("actor", "column_name").agg(F.sum("n").alias("total"), F.max("n").alias("n"), F.min(F.struct((-F.col("n")).alias("o"), "value")).alias("b"))
    return best.select("actor", "column_name", "b.value", "n", (F.col("n") / F.col("total")).alias("share"))


def actor_profiles(df: DataFrame, actor: str, time: str) -> DataFrame:
    """(actor, events, span_days, h0..h23, d0..d6): events, days between first and last, and shares by hour and weekday (Monday 0)."""
    t = F.col(time).cast("timestamp")
    n = F.count(t)
    hours = [F.try_divide(F.count(F.when(F.hour(t) == h, 1)), n).alias(f"h{h}") for h in range(24)]
    days = [F.try_divide(F.count(F.when(F.weekday(t) == d, 1)), n).alias(f"d{d}") for d in range(7)]
    span = (F.unix_millis(F.max(t)) - F.unix_millis(F.min(t))) / 86_400_000.0
    return df.where(F.col(actor).isNotNull()).groupBy(F.col(actor).alias("actor")).agg(F.count(F.lit(1)).alias("events"), span.alias("span_days"), *hours, *days)


def features(profiles: DataFrame) -> DataFrame:
    """(actor, f0..f32): ln(events+1), span and the 31 shares, standardised over all actors. The means are one broadcast row."""
    raw = [F.log1p("events"), F.col("span_days"), *[F.col(f"h{h}") for h in range(24)], *[F.col(f"d{d}") for d in range(7)]]
    named = profiles.select("actor", *[c.cast("double").alias(f"f{i}") for i, c in enumerate(raw)])
    stats = named.agg(*[a for i in range(33) for a in (F.avg(f"f{i}").alias(f"m{i}"), F.stddev_pop(f"f{i}").alias(f"s{i}"))])
    z = [F.coalesce(F.try_divide(F.col(f"f{i}") - F.col(f"m{i}"), F.col(f"s{i}")), F.lit(0.0)).alias(f"f{i}") for i in range(33)]
    return named.join(F.broadcast(stats)).select("actor", *z)


def segments(feature_rows: DataFrame, seed: int = 7) -> DataFrame:
    """(actor, segment): k-means with the k of the best silhouette, k from 2 to min(ceil(sqrt n), 10, n/2) and below
    the number of different feature rows. Segments of fewer than two
    actors lose to smaller k. Fewer than four actors form one segment."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    marked = feature_rows.withColumn("__point", F.xxhash64(*[F.round(f"f{i}", 9) for i in range(33)]))
    rows = checkpoint(VectorAssembler(inputCols=[f"f{i}" for i in range(33)], outputCol="features").transform(marked).select("actor", "features", "__point"))
    n, points = rows.agg(F.count(F.lit(1)), F.count_distinct("__point")).first()
    best, top = None, -2.0
    for k in range(2, min(math.ceil(math.sqrt(n)), 10, n // 2, points if points <= 2 else points - 1) + 1 if n >= 4 else 2):
        made = KMeans(k=k, seed=seed, maxIter=50).fit(rows).transform(rows)
        if made.groupBy("prediction").count().agg(F.min("count")).first()[0] < 2:
            continue
        score = ClusteringEvaluator(predictionCol="prediction").evaluate(made)
        if score > top:
            best, top = made, score
    return rows.select("actor", F.lit(0).alias("segment")) if best is None else best.select("actor", F.col("prediction").alias("segment"))


def edges(df: DataFrame, source: str, target: str) -> DataFrame:
    """(src, dst, n) of distinct directed pairs."""
    return df.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).cast("string").alias("src"), F.col(target).cast("string").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def _neighbour_pairs(e: DataFrame) -> DataFrame:
    """One row (pairs, closed): the pairs of different out-neighbours of each node but itself, and those of them joined by an edge of
    either direction. Pairs follow from the out-degrees. Closed ones are corners of triangles, which are listed from their corner of
    least degree, so no node, a hub included, has more than sqrt(2 E) links to pair and pairs not closed are at most E sqrt(2 E)."""
    arcs = e.where("src <> dst").select("src", "dst").distinct()
    d = F.col("d").cast("double")
    pairs = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.sum(d * (d - 1) / 2), F.lit(0.0)).alias("pairs"))
    links = arcs.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max((F.col("src") < F.col("dst")).cast("int")).alias("ab"), F.max((F.col("src") > F.col("dst")).cast("int")).alias("ba"))
    links = checkpoint(links)  # used five times, at most one row per edge
    reach = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    both = links.join(reach.select(F.col("node").alias("a"), F.col("deg").alias("da")), "a").join(reach.select(F.col("node").alias("b"), F.col("deg").alias("db")), "b")
    up = F.struct(F.col("da").alias("k"), F.col("a").alias("v")) < F.struct(F.col("db").alias("k"), F.col("b").alias("v"))
    pick = lambda x, y: F.when(up, F.col(x)).otherwise(F.col(y))
    # from the end of lesser degree: there, back
    sides = lambda v, there, back: both.select(pick("a", "b").alias("u"), pick("b", "a").alias(v), pick("ab", "ba").alias(there), pick("ba", "ab").alias(back))
    wedges = sides("a", "ua", "au").join(sides("b", "ub", "bu"), "u").where("a < b")
    corners = wedges.join(links, ["a", "b"]).agg(F.coalesce(F.sum(F.col("ua") * F.col("ub") + F.col("au") * F.col("ab") + F.col("bu") * F.col("ba")), F.lit(0)).alias("closed"))
    return pairs.join(F.broadcast(corners))


def graph_metrics(e: DataFrame) -> DataFrame:
    """One row of the graph's nodes, edges, mean degree, degree variation, reciprocity, clustering and class.

    Clustering is the share of all pairs of out-neighbours, over all source nodes, that are joined by an edge; 0 without pairs.
    """
    degree = e.select(F.explode(F.array("src", "dst")).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("degree"))
    d = degree.agg(F.count(F.lit(1)).alias("nodes"), F.avg("degree").alias("mean_degree"), F.stddev_pop("degree").alias("sd"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("hit"))
    r = e.join(back, ["src", "dst"], "left").agg(F.count(F.lit(1)).alias("edges"), F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("reciprocity"))
    c = _neighbour_pairs(e).select(F.coalesce(F.try_divide(F.col("closed").cast("double"), "pairs"), F.lit(0.0)).alias("clustering"))
    cv, rec, cl = F.try_divide("sd", "mean_degree"), F.col("reciprocity"), F.col("clustering")
    kind = F.when((rec < 0.2) & (cv > 1), "hierarchical").when(cv > 1.5, "scale_free").when((cl > 0.3) & (rec > 0.3), "small_world").when((cv < 0.5) & (rec > 0.4), "erdos_renyi").otherwise("custom")
    return d.join(F.broadcast(r)).join(F.broadcast(c)).select("nodes", "edges", "mean_degree", cv.alias("degree_cv"), "reciprocity", "clustering", kind.alias("class"))


def communities(nodes: int, mean_degree: float, cv: float) -> int:
    """How many communities a graph is modelled with."""
    if nodes < 6:
        return 1
    if cv > 1.5:
        return min(math.ceil(nodes / mean_degree), 10)
    return min(math.ceil(math.sqrt(nodes) / 2), 5) if cv > 0.5 else 1


def depth(nodes: int, reciprocity: float, variance: float) -> int:
    """How many levels a graph is modelled with."""
    return 1 if reciprocity > 0.5 or nodes < 4 else min(math.ceil(math.log(nodes) / 2) + (variance > 10), 8)
