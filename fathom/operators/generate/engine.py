"""From a blueprint to tables: every field is a lazy column of the row number, in the order its dependencies need.

Parents need not exist to make their children: keys that follow from row numbers, by arithmetic or by their generator, are computed where they are
referred to, so tables are independent plans. Other keys are looked up by row number. Only the fields
asked for are computed, since unused columns are pruned.
"""

from __future__ import annotations

import re
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.expressions import fields_of, is_template, parse
from fathom.functions.rng import Rng
from fathom.operators.generate.columns import GENERATORS, Context, Keys, make, null_mask
from fathom.operators.generate.wholes import WHOLES, Build, edge_rows, gaussian_copulas

ROWS_PER_PARTITION = 1_048_576
LEAST_ROWS = 65_536
#: Generators for fields that name none, by type.
DEFAULTS = {"bool": {"type": "distribution", "family": "bernoulli"}, "int": {"type": "distribution", "family": "uniform", "params": {"min": 0, "max": 1000}, "round": True}, "float": {"type": "distribution"}, "string": {"type": "faker", "kind": "word"}, "date": {"type": "faker", "kind": "date"}, "datetime": {"type": "faker", "kind": "datetime"}, "uuid": {"type": "uuid"}}
SPARK_TYPES = {"bool": "boolean", "int": "bigint", "int32": "int", "float": "double", "string": "string", "uuid": "string", "date": "date", "datetime": "timestamp", "time": "bigint", "duration": "bigint", "bytes": "binary"}


def row_source(spark: SparkSession, rows: int, per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """(__row): 0-based row numbers in partitions of bounded size, and of less where that keeps all cores busy."""
    even = max(LEAST_ROWS, -(-rows // spark.sparkContext.defaultParallelism))
    return spark.range(0, rows, 1, max(1, -(-rows // min(per_partition, even)))).withColumnRenamed("id", "__row")


#: Options of generators that name other fields.
READS = ("field", "actor_field", "source", "series", "time")


def fields_in(model: dict, name: str) -> dict:
    """A table's fields, with the properties of the edges that its rows are."""
    out = dict(model["tables"][name].get("fields", {}))
    for r in model.get("relationships", []):
        if r.get("from_table") == name:
            out |= {p["name"]: {k: v for k, v in p.items() if k != "name"} for p in r.get("properties", [])}
    return out


def dependencies(fields: dict) -> dict[str, set[str]]:
    """The other fields that each field reads."""
    out = {}
    for name, spec in fields.items():
        reads: set[str] = set()
        todo = [spec.get("generator", {})]
        while todo:
            g = todo.pop()
            reads |= {g[k] for k in READS if isinstance(g.get(k), str)}
            e = g.get("expression")
            if e:
                reads |= set(re.findall(r"\$\{([^}]*)\}", e)) if is_template(e) else fields_of(parse(e))
            # generators within generators
            todo += [v for v in g.values() if isinstance(v, dict) and "type" in v]
            todo += [x for v in g.values() if isinstance(v, dict) and "type" not in v for x in v.values() if isinstance(x, dict) and "type" in x]
        out[name] = reads & (fields.keys() - {name})
    return out


def layers(fields: dict) -> list[list[str]]:
    """Fields in layers, each of which reads only earlier ones; a circle is an error."""
    sorter, out = TopologicalSorter(dependencies(fields)), []
    sorter.prepare()
    while sorter.is_active():
        ready = sorted(sorter.get_ready(), key=list(fields).index)
        out.append(ready)
        sorter.done(*ready)
    return out


def _shaped(spec: dict, c: Column) -> Column:
    """A field's values as its type and precision have them."""
    if "precision" in spec:
        c = F.round(c, spec["precision"])
    kind = spec.get("type", "string")
    return c.cast(SPARK_TYPES[kind]) if kind in SPARK_TYPES else c


def keys_of(model: dict, name: str, portable: bool = False) -> Keys:
    """How a table's keys follow from row numbers: by arithmetic for a sequence or for tables without a primary key, by the key's generator where it
    looks at nothing but the row, else not at all."""
    table, seed = model["tables"][name], model.get("seed", 0)
    fields = fields_in(model, name)
    for f, spec in fields.items():
        if not spec.get("primary_key"):
            continue
        g = spec.get("generator") or DEFAULTS.get(spec.get("type", "string"), {"type": "constant"})
        if g.get("type") == "sequence" and not g.get("width") and spec.get("type", "int") in ("int", "string"):
            return Keys(table["count"], g.get("start", 1), g.get("step", 1), g.get("prefix", "" if spec.get("type") == "string" else None))
        if g.get("type") not in GENERATORS or g.get("type") in ("fk", "junction", "hierarchy") or dependencies(fields)[f] or spec.get("null") is not None or table.get("edges"):
            return Keys(table["count"], joined=True)
        return Keys(table["count"], maker=lambda i: _shaped(spec, make(Context(seed, name, f, table["count"], row=i, portable=portable, model=model), g)))
    return Keys(table["count"])


def generate_table(spark: SparkSession, model: dict, name: str, portable: bool = False, numbered: bool = False) -> DataFrame:
    """A table of a model; ``numbered`` keeps its row numbers as __row."""
    table, seed, fields = model["tables"][name], model.get("seed", 0), fields_in(model, name)
    parents = {n: keys_of(model, n, portable) for n in model["tables"]}
    build = Build(spark, model, name, parents, lambda other: generate_table(spark, model, other, portable, numbered=True), portable)
    edges = edge_rows(build)
    df = row_source(spark, table["count"]) if edges is None else edges
    for layer in layers(fields):
        made = {}
        for f in layer:
            spec = fields[f]
            g = spec.get("generator") or DEFAULTS.get(spec.get("type", "string"), {"type": "constant"})
            ctx = Context(seed, name, f, table["count"], portable=portable, schema=df.schema, parents=parents, model=model)
            looked_up = g["type"] == "fk" and (parents[g["parent"]].joined or g.get("weight_field"))
            if g["type"] in WHOLES and (g["type"] not in GENERATORS or looked_up):
                df = WHOLES[g["type"]](build, df, f, **{k: v for k, v in g.items() if k != "type"})
                made[f] = F.col(f"`{f}`")
            else:
                made[f] = make(ctx, g)
            made[f] = _shaped(spec, made[f])
            nulls = spec.get("null")
            if nulls is not None:
                made[f] = null_mask(ctx, made[f], every=nulls["every"]) if isinstance(nulls, dict) else null_mask(ctx, made[f], float(nulls))
        df = df.withColumns(made)
    df = gaussian_copulas(build, df)
    for c in table.get("constraints", []):
        df = enforce(df, c)
    return df.select(*(["__row"] if numbered else []), *fields)


def enforce(df: DataFrame, constraint: dict) -> DataFrame:
    """{"range": [field, low, high]} clamps; {"ordered": [a, b]} swaps the two where a > b. Nulls stay."""
    if "range" in constraint:
        f, low, high = constraint["range"]
        x = F.col(f"`{f}`")
        return df.withColumn(f, F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x).cast(df.schema[f].dataType))
    a, b = constraint["ordered"]
    wrong = F.col(a) > F.col(b)
    return df.withColumns({a: F.when(wrong, F.col(b)).otherwise(F.col(a)), b: F.when(wrong, F.col(a)).otherwise(F.col(b))})


def generate(spark: SparkSession, model: dict, portable: bool = False) -> dict[str, DataFrame]:
    return {name: generate_table(spark, model, name, portable) for name in model["tables"]}


def grid(spark: SparkSession, left: DataFrame, right: DataFrame) -> DataFrame:
    """A panel: every combination of two small sets, whose sizes are checked."""
    if left.count() * right.count() > 100_000_000:
        raise ValueError("the panel would exceed a hundred million rows")
    return left.join(F.broadcast(right))


def activity_counts(weights: dict[str, float], actors: int, trait: float = 1.0) -> dict[str, int]:
    """Rows per activity table from the number of actors."""
    return {k: round(w * actors * trait) for k, w in weights.items()}


def partition_by_weight(df: DataFrame, seed: int, key: str, values: list[str], weights: list[float], name: str) -> DataFrame:
    """A partition column whose values take the weights' shares."""
    return df.withColumn(name, Rng(seed, "partition", F.col(key)).weighted(values, weights, name))
