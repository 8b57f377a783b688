"""Whole models: shops, social posts, sensors, accounts, staff, servers and departments, and the closure of their references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import hierarchy
from fathom.operators.generate import engine, graphs
from fathom.sources.tables import table


def _seq(start: int = 1) -> dict:
    return {"type": "int", "primary_key": True, "generator": {"type": "sequence", "start": start}}


def _fk(parent: str, kind: str = "int", **options) -> dict:
    return {"type": kind, "generator": {"type": "fk", "parent": parent, **options}}


def _fake(kind: str) -> dict:
    return {"type": "string", "generator": {"type": "faker", "kind": kind}}


def _pick(*values: object, kind: str = "string") -> dict:
    return {"type": kind, "generator": {"type": "one_of", "values": list(values)}}


def _number(family: str = "uniform", kind: str = "float", **params: float) -> dict:
    return {"type": kind, "generator": {"type": "distribution", "family": family, "params": params, "round": kind == "int"}}


def _uuid() -> dict:
    return {"type": "uuid", "primary_key": True, "generator": {"type": "uuid"}}


def _model(tables: dict[str, tuple[int, dict]], **more: object) -> dict:
    return {"seed": 11, "tables": {n: {"count": c, "fields": f} for n, (c, f) in tables.items()}, **more}


_TIME = {"type": "datetime", "generator": {"type": "business_hours"}}
MODELS: dict[str, dict] = {
    "ecommerce": _model({
        "users": (800, {"id": _uuid(), "username": _fake("username"), "email": {"type": "string", "generator": {"type": "unique", "of": {"type": "faker", "kind": "email"}}}, "tier": _pick("free", "plus"), "age": _number("normal", "int", mean=40, std_dev=12), "created_at": _TIME}),
        "products": (200, {"id": _seq(), "sku": _fake("sku"), "name": _fake("product"), "price": _number("log_normal", mu=3, sigma=0.6), "category": _pick("books", "tools"), "popularity": _number("pareto", scale=1.0, shape=1.5)}),
        "orders": (5000, {"id": _seq(), "user_id": _fk("users", "string"), "product_id": _fk("products", weight_field="popularity"), "quantity": _number("poisson", "int", **{"lambda": 2.0}), "status": _pick("open", "paid", "sent")}),
        "reviews": (3000, {"id": _seq(), "user_id": _fk("users", "string", selection="zipf"), "product_id": _fk("products", selection="clustered"), "rating": _pick(1, 2, 3, 4, 5, kind="int"), "comment": _fake("sentence")}),
    }, relationships=[{"from_table": "orders", "foreign_key": "user_id", "to_table": "users", "to_column": "id", "properties": [{"name": "gift", "type": "bool", "generator": {"type": "distribution", "family": "bernoulli", "params": {"p": 0.2}}}]}]),
    "social": _model({
        "users": (500, {"id": _seq(1000), "username": _fake("username"), "signup": _TIME}),
        "posts": (2000, {"id": _seq(), "author_id": {"type": "int", "generator": {"type": "actor_ref", "actor": "users", "activity": {"family": "pareto", "params": {"scale": 1.0, "shape": 1.2}}}}, "mood": {"type": "string", "generator": {"type": "persona_field", "field": "author_id", "trait": "mood"}}, "content": _fake("paragraph"), "likes": _number("geometric", "int", p=0.1)}),
        "comments": (3000, {"id": _seq(), "post_id": _fk("posts"), "author_id": _fk("users"), "reply_to": {"type": "int", "generator": {"type": "thread_ref", "reply": 0.5, "window": 30, "max_depth": 4}}}),
        "messages": (2500, {"id": _seq(), "sender_id": _fk("users"), "receiver_id": {"type": "int", "generator": {"type": "relationship_ref", "actor_field": "sender_id", "graph": "friends"}}, "sent_at": {"type": "datetime", "generator": {"type": "actor_bursts", "actor_field": "sender_id"}}}),
    }, personas={"owl": {"weight": 1, "traits": {"mood": "late"}}, "lark": {"weight": 3, "traits": {"mood": "early"}}}, graphs={"friends": {"kind": "small_world", "actor": "users", "k": 6, "beta": 0.2}}),
    "iot": _model({
        "devices": (50, {"serial": {"type": "string", "primary_key": True, "generator": {"type": "unique", "of": {"type": "pattern", "pattern": "AA-#"}}}, "kind": {"type": "string", "generator": {"type": "tuple_lookup", "tuple": "kinds", "column": "kind"}}, "unit": {"type": "string", "generator": {"type": "tuple_lookup", "tuple": "kinds", "column": "unit"}}, "lat": _fake("latitude")}),
        "readings": (10_000, {"id": _seq(), "serial": _fk("devices", "string"), "at": {"type": "datetime", "generator": {"type": "event_stream", "series": "serial", "rate_per_s": 0.01}}, "value": {"type": "float", "generator": {"type": "numeric_time_series", "series": "serial", "start": 20.0, "seasons": [{"period": 24, "amplitude": 3}], "noise": 0.5, "ar": [0.7]}}}),
        "alerts": (500, {"id": _seq(), "serial": _fk("devices", "string", selection="sequential"), "severity": _pick("low", "high")}),
    }, tuples={"kinds": {"columns": ["kind", "unit"], "rows": [["heat", "C"], ["wind", "m/s"], ["light", "lx"]], "weights": [3, 1, 1]}}),
    "financial": _model({
        "accounts": (500, {"number": {"type": "string", "primary_key": True, "generator": {"type": "sequence", "prefix": "AC-", "width": 8}}, "iban": _fake("iban"), "balance": _number("normal", mean=5000, std_dev=900), "risk": _number("beta", alpha=2.0, beta=5.0)}),
        "transactions": (10_000, {"id": _seq(), "account": _fk("accounts", "string"), "amount": {"type": "float", "generator": {"type": "correlated", "source": "score", "r": 0.7, "mean": 100.0, "std": 20.0}}, "score": _number("normal"), "channel": _pick("web", "branch")}),
    }),
    "hr": _model({
        "departments": (20, {"id": _seq(), "name": {"type": "string", "generator": {"type": "dictionary", "mode": "combinatorial", "values": [["North", "South", "East", "West"], ["Sales", "Design", "Care"]]}}, "budget": _number("gamma", shape=2.0, scale=1000.0)}),
        "employees": (500, {"id": _seq(), "department_id": _fk("departments"), "manager_id": {"type": "int", "generator": {"type": "hierarchy", "max_depth": 4}}, "salary": _number("log_normal", mu=10, sigma=0.3), "name": _fake("name")}),
        "tasks": (5000, {"id": _seq(), "assignee_id": _fk("employees"), "points": _pick(1, 2, 3, 5, kind="int")}),
        "skills": (40, {"id": _seq(), "name": _fake("word")}),
        "employee_skills": (3000, {"employee_id": {"type": "int", "generator": {"type": "junction", "parents": ["employees", "skills"], "side": 0}}, "skill_id": {"type": "int", "generator": {"type": "junction", "parents": ["employees", "skills"], "side": 1}}}),
    }),
    "logs": _model({
        "servers": (10, {"host": {"type": "string", "primary_key": True, "generator": {"type": "derived", "expression": 'concat("srv-", cast_string(${n}))'}}, "n": {"type": "int", "generator": {"type": "sequence", "start": 7, "step": 3}}}),
        "requests": (20_000, {"id": _seq(), "host": _fk("servers", "string"), "status": _pick(200, 404, 500, kind="int"), "ms": _number("log_normal", mu=3, sigma=1)}),
        "errors": (1000, {"id": _seq(), "host": _fk("servers", "string", selection="sequential"), "level": _pick("warn", "error")}),
    }),
    "hierarchy": _model({
        "department": (5, {"id": _seq(), "name": _fake("word")}),
        "employee": (200, {"id": _uuid(), "department_id": _fk("department"), "title": _fake("job"), "manager_id": {"type": "string", "generator": {"type": "hierarchy", "max_depth": 3}}}),
    }),
}
#: Child table and column, parent table and column, whether null means no reference.
LINKS = {
    "ecommerce": [("orders", "user_id", "users", "id"), ("orders", "product_id", "products", "id"), ("reviews", "user_id", "users", "id"), ("reviews", "product_id", "products", "id")],
    "social": [("posts", "author_id", "users", "id"), ("comments", "post_id", "posts", "id"), ("comments", "author_id", "users", "id"), ("comments", "reply_to", "comments", "id"), ("messages", "sender_id", "users", "id"), ("messages", "receiver_id", "users", "id")],
    "iot": [("readings", "serial", "devices", "serial"), ("alerts", "serial", "devices", "serial")],
    "financial": [("transactions", "account", "accounts", "number")],
    "hr": [("employees", "department_id", "departments", "id"), ("employees", "manager_id", "employees", "id"), ("tasks", "assignee_id", "employees", "id"), ("employee_skills", "employee_id", "employees", "id"), ("employee_skills", "skill_id", "skills", "id")],
    "logs": [("requests", "host", "servers", "host"), ("errors", "host", "servers", "host")],
    "hierarchy": [("employee", "department_id", "department", "id"), ("employee", "manager_id", "employee", "id")],
}


def _orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(rows, orphans): rows of the child, and those whose non-null reference has no parent."""
    keys = parent.select(F.col(key).alias("r"), F.lit(True).alias("hit")).distinct()
    rows = child.select(F.col(column).alias("r")).join(keys, "r", "left")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("r").isNotNull() & F.col("hit").isNull(), 1)).alias("orphans"))


def gen_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and orphans of every reference of the seven models."""
    parts = []
    for name, model in MODELS.items():
        made: dict[str, DataFrame] = {}
        for child, column, parent, key in LINKS[name]:
            for t in (child, parent):
                made.setdefault(t, engine.generate_table(spark, model, t))
            parts.append(_orphans(made[child], column, made[parent], key).select(F.lit(name).alias("model"), F.lit(child).alias("child"), F.lit(column).alias("reference"), "rows", "orphans"))
    return reduce(DataFrame.unionByName, parts)


def gen_model_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, n): what must hold of the models, counted so that 0 is right."""

    def made(model: str, name: str) -> DataFrame:
        return engine.generate_table(spark, MODELS[model], name)

    hr, skills = made("hr", "employees"), made("hr", "employee_skills")
    tree = hierarchy.roots(hr, "id", "manager_id")
    kinds = made("iot", "devices")
    posts = made("social", "posts")
    replies = made("social", "comments").where("reply_to is not null")
    depth = hierarchy.roots(made("social", "comments"), "id", "reply_to")
    counts = {
        "circles of managers": tree.where("cycle_id is not null"),
        "managers deeper than allowed": tree.where("depth > 4"),
        "pairs of employee and skill that come twice": skills.groupBy("employee_id", "skill_id").count().where("count > 1"),
        "tuples that do not belong together": kinds.where("not ((kind = 'heat' and unit = 'C') or (kind = 'wind' and unit = 'm/s') or (kind = 'light' and unit = 'lx'))"),
        "serial numbers that come twice": kinds.groupBy("serial").count().where("count > 1"),
        "actors with two moods": posts.groupBy("author_id").agg(F.count_distinct("mood").alias("m")).where("m <> 1"),
        "replies to later comments": replies.where("reply_to >= id"),
        "threads deeper than allowed": depth.where("depth > 4 or cycle_id is not null"),
        "names of departments before all are used": made("hr", "departments").where("id <= 12").groupBy("name").count().where("count > 1"),
        "times of a device that go back": _backward(made("iot", "readings")),
    }
    return reduce(DataFrame.unionByName, [d.agg(F.lit(k).alias("rule"), F.count(F.lit(1)).alias("n")) for k, d in counts.items()])


def _backward(readings: DataFrame) -> DataFrame:
    from fathom.operators.relational import lagged

    return lagged(readings.select("serial", "id", "at"), ["serial"], ["id"], "at").where("previous > at")


def gen_fk_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zipf reference to a million parents: how many children, orphans, and whether some go to parents beyond the first hundred thousand."""
    model = _model({"p": (1_000_000, {"id": _seq()}), "c": (200_000, {"id": _seq(), "p_id": _fk("p", selection="zipf")})})
    c, p = engine.generate_table(spark, model, "c"), engine.generate_table(spark, model, "p")
    lost = c.join(p.select(F.col("id").alias("p_id")), "p_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    share = F.avg((F.col("p_id") > 100_000).cast("double"))
    # of the weight of a million ranks, 16 % lie beyond the first hundred thousand
    return c.agg(F.count(F.lit(1)).alias("rows"), share.between(0.15, 0.17).alias("reaches_beyond")).join(F.broadcast(lost))


def gen_graph_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of graph: edges from a node to itself, ends that are no node, edges that come twice, and whether the number of edges is as stated."""
    n = 2000
    made = {
        "complete": (graphs.complete(spark, 60), 60, 60 * 59, 60 * 59),
        "erdos_renyi": (graphs.erdos_renyi(spark, n, 0.002, 1), n, 7200, 8300),
        "small_world": (graphs.small_world(spark, n, 4, 0.3, 1), n, 3800, 4000),
        "scale_free": (graphs.scale_free(spark, n, 2, 1), n, 3300, 4000),
        "blocks": (graphs.blocks(spark, 900, 3, 0.01, 0.002, 1), 900, 3000, 3600),
        "configuration": (graphs.configuration(spark, n, 4.0, 1), n, 3600, 4300),
        "hierarchical": (graphs.lateral_hierarchy(spark, n, 4, 1), n, 1999, 2400),
    }
    parts = []
    for kind, (e, nodes, low, high) in made.items():
        outside = ~F.col("src").between(0, nodes - 1) | ~F.col("dst").between(0, nodes - 1)
        one = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
        parts.append(one.agg(F.lit(kind).alias("kind"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"), F.count(F.when(outside, 1)).alias("outside"), F.count(F.when(F.col("k") > 1, 1)).alias("repeated"), F.sum("k").between(low, high).alias("as_many")))
    return reduce(DataFrame.unionByName, parts)


def gen_hierarchy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a generated hierarchy: nodes, tops, circles and the greatest depth, found by contraction."""
    found = hierarchy.roots(graphs.random_tree(spark, 5000, 11, max_depth=4), "node", "parent")
    return found.agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("depth") == 0, 1)).alias("tops"), F.count("cycle_id").alias("circles"), F.max("depth").alias("depth"))


def gen_recurrence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recurrence in blocks of 64 steps against one in a single block: rows, and the values that differ."""
    from fathom.functions.rng import Rng
    from fathom.operators.generate import series

    rows = engine.row_source(spark, 5000).withColumns({"series": F.col("__row") % 10, "step": F.floor(F.col("__row") / 10)})
    run = lambda block, name: series.recurrence(rows, Rng(3, "rec", F.col("__row")), "series", "step", name, ar=[0.6, 0.2], reversion=0.1, spike_p=0.02, spike_size=9.0, block=block)
    both = run(64, "a").select("__row", "a").join(run(10_000, "b").select("__row", "b"), "__row")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.abs(F.col("a") - F.col("b")) > 1e-9, 1)).alias("differ"))


def gen_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations looked up in turn from a table's file, and names of a row that belong together."""
    path = f"{sf_dir}/nation.parquet"
    field = lambda kind, **o: {"type": "string", "generator": {"type": kind, "path": path, **o}}
    model = _model({"t": (1000, {"turn": field("external_lookup", column="n_name", mode="sequential"), "name": field("row_lookup", column="n_name"), "key": field("row_lookup", column="n_nationkey")})})
    made = engine.generate_table(spark, model, "t")
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("key"))
    wrong = made.join(nation, ["name", "key"], "left_anti").agg(F.count(F.lit(1)).alias("torn"))
    return made.groupBy("turn").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(wrong))


#: Means and deviations that the parameters below state.
_MOMENTS = {"poisson": ({"lambda": 4.0}, 4.0, 2.0), "binomial": ({"n": 20, "p": 0.3}, 6.0, 2.049390), "zipf": ({"n": 50, "s": 1.2}, 8.483214, 11.107263), "gamma": ({"shape": 2.5, "scale": 2.0}, 5.0, 3.162278), "beta": ({"alpha": 2.0, "beta": 5.0}, 0.285714, 0.159719), "chi_squared": ({"k": 4.0}, 4.0, 2.828427), "student_t": ({"n": 6.0}, 0.0, 1.224745)}


def gen_moment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that need a table or rejection, on 100 000 rows: whether mean and deviation are within 3 % of a deviation of what they should be."""
    from fathom.operators.generate import columns

    ctx = {f: columns.Context(7, "moments", f, 100_000) for f in _MOMENTS}
    df = engine.row_source(spark, 100_000).select(*[columns.distribution_(ctx[f], f, p).alias(f) for f, (p, _, _) in _MOMENTS.items()])
    cells = [F.struct(F.lit(f).alias("family"), (F.abs(F.avg(f) - m) <= 0.03 * d).alias("mean"), (F.abs(F.stddev_pop(f) / d - 1) <= 0.03).alias("deviation")) for f, (_, m, d) in _MOMENTS.items()]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def gen_copula_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns reordered to a rank correlation of .8: rows, values that changed, and whether the correlation is near."""
    from fathom.functions.rng import Rng
    from fathom.operators.generate import series

    p = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") * 1.5).alias("other"))
    made = series.gaussian_copula(p, Rng(4, "gc", F.col("c_custkey")), "c_custkey", ["c_acctbal", "other"], [[1.0, 0.8], [0.8, 1.0]])
    changed = made.select("c_acctbal").exceptAll(p.select("c_acctbal")).agg(F.count(F.lit(1)).alias("changed"))
    return made.agg(F.count(F.lit(1)).alias("rows"), F.corr("c_acctbal", "other").between(0.7, 0.9).alias("near")).join(F.broadcast(changed))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("gen_")}

_RULES = ("circles of managers", "managers deeper than allowed", "pairs of employee and skill that come twice", "tuples that do not belong together", "serial numbers that come twice", "actors with two moods", "replies to later comments", "threads deeper than allowed", "names of departments before all are used", "times of a device that go back")
SQL = {
    "gen_models": " union all ".join(f"select '{m}' model, '{c}' child, '{r}' reference, cast({MODELS[m]['tables'][c]['count']} as bigint) as \"rows\", cast(0 as bigint) orphans" for m, links in LINKS.items() for c, r, _, _ in links),
    "gen_model_rules": " union all ".join(f"select '{r}' as \"rule\", cast(0 as bigint) n" for r in _RULES),
    "gen_fk_zipf": 'select cast(200000 as bigint) as "rows", true reaches_beyond, cast(0 as bigint) orphans',
    "gen_graph_rules": " union all ".join(f"select '{k}' kind, cast(0 as bigint) loops, cast(0 as bigint) outside, cast(0 as bigint) repeated, true as_many" for k in ("complete", "erdos_renyi", "small_world", "scale_free", "blocks", "configuration", "hierarchical")),
    "gen_moment_rules": " union all ".join(f"select '{f}' family, true mean, true deviation" for f in _MOMENTS),
    "gen_copula_rules": 'select count(*) as "rows", true near, cast(0 as bigint) changed from customer',
    "gen_hierarchy_rules": "select cast(5000 as bigint) nodes, cast(1 as bigint) tops, cast(0 as bigint) circles, cast(4 as bigint) depth",
    "gen_recurrence_rules": 'select cast(5000 as bigint) as "rows", cast(0 as bigint) differ',
    "gen_external": "select n_name turn, cast(40 as bigint) n, cast(0 as bigint) torn from nation",
}
