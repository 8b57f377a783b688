"""From profiles to a blueprint: which generator stands for each learned column.

Everything is measured in a few aggregations per table; what reaches the driver is of the size of the schema (and, for categories, at most
``MAX_VALUES`` shares per column). First match wins: foreign key, primary key, boolean, category, fitted distribution for numbers, span of
times, text pattern, else a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators.learn import fit, profile
from fathom.operators.learn.decisions import Decisions

MAX_VALUES = 50
#: Parameters of the generator that stands for a fitted family, from the fit's a and b.
FAMILIES = {
    "uniform": lambda a, b: {"min": a, "max": b}, "normal": lambda a, b: {"mean": a, "std_dev": b}, "log_normal": lambda a, b: {"mu": a, "sigma": b},
    "exponential": lambda a, b: {"lambda": a}, "pareto": lambda a, b: {"scale": a, "shape": b}, "poisson": lambda a, b: {"lambda": a}, "gamma": lambda a, b: {"shape": a, "scale": b}, "beta": lambda a, b: {"alpha": a, "beta": b}, "zipf": lambda a, b: {"n": int(a), "s": b},
}
TEXTS = {"email": "email", "phone": "phone", "uuid": "uuid", "url": "url", "name": "name", "hex": "hex", "date": "date"}
GEOGRAPHIC = ("city", "town", "state", "province", "region", "country", "zip", "postal", "postcode", "latitude", "longitude")


def geographic(columns: list[str]) -> list[str]:
    """Columns that name parts of a place, which are sampled together if there are at least two."""
    found = [c for c in columns if any(g in c.lower() for g in GEOGRAPHIC)]
    return found if len(found) > 1 else []


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "float"
    if isinstance(t, T.DateType):
        return "date"
    return "datetime" if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else "string"


def learn_table(df: DataFrame, key: str | None = None, references: dict[str, str] | None = None, max_values: int = MAX_VALUES, log: Decisions | None = None, name: str = "") -> dict:
    """The blueprint of one table. ``references`` maps foreign key columns to parent tables; columns of up to ``max_values`` values become categories;
    ``log`` takes down why each column got its generator."""
    references = references or {}
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    names = [f.name for f in plain]
    kinds = {f.name: _kind(f.dataType) for f in plain}
    counts = {r.column_name: r for r in profile.column_counts(df, names, None).collect()}
    rows = counts[names[0]].rows if names else 0
    few = [c for c in names if 0 < counts[c].distinct <= max_values and c not in references and c != key and kinds[c] in ("string", "bool", "int")]
    shares: dict[str, list] = {c: [] for c in few}
    if few:
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in few])
        for r in df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).collect():
            shares[r.c].append((r.v, r.n))
    numbers = [c for c in names if kinds[c] in ("int", "float") and c not in few and c not in references and c != key]
    fits = {r.column_name: r for r in fit.best(fit.sufficient(df, numbers)).collect()} if numbers else {}
    times = [c for c in names if kinds[c] in ("date", "datetime")]
    spans = {r.column_name: r for r in profile.temporal_profile(df, times).collect()} if times else {}
    texts = [c for c in names if kinds[c] == "string" and c not in few and c not in references and c != key]
    forms = {r.column_name: r.asDict() for r in profile.text_profile(df, texts).collect()} if texts else {}

    def chosen(c: str) -> dict:
        if c in references:
            return {"type": "fk", "parent": references[c]}
        if c == key:
            return {"type": "sequence"} if kinds[c] == "int" else {"type": "uuid"}
        if c in few:
            values = sorted(shares[c], key=lambda x: (-x[1], x[0]))
            cast = {"int": int, "bool": lambda v: v == "true"}.get(kinds[c], str)
            return {"type": "one_of", "values": [cast(v) for v, _ in values], "weights": [n for _, n in values]}
        if c in fits:
            r = fits[c]
            return {"type": "distribution", "family": r.family, "params": FAMILIES[r.family](r.a, r.b), "round": kinds[c] == "int"}
        if c in spans and spans[c].first is not None:
            return {"type": "derived", "expression": f"from_epoch(random_float({spans[c].first / 1000.0!r}, {spans[c].last / 1000.0 + 0.001!r}))"}
        if c in forms:
            best = max(TEXTS, key=lambda k: forms[c][f"{k}_rate"] or 0.0)
            return {"type": "faker", "kind": TEXTS[best] if (forms[c][f"{best}_rate"] or 0.0) >= 0.95 else "words"}
        return {"type": "constant", "value": None}

    fields = {}
    for c in names:
        f = {"type": kinds[c], "generator": chosen(c)}
        if log is not None:
            why = "reference" if c in references else "key" if c == key else f"{counts[c].distinct} different values" if c in few else f"least AIC {fits[c].aic:.6g}" if c in fits else "span of times" if c in spans else "pattern of texts" if c in forms else "nothing known"
            log.add(name, c, "generator", f["generator"]["type"], why)
        if c == key:
            f["primary_key"] = True
        rate = counts[c].null_rate or 0.0
        if rate > 0 and f["generator"]["type"] != "constant":
            f["null"] = rate
        fields[c] = f
    return {"count": rows, "fields": fields}


def learn_model(tables: dict[str, DataFrame], keys: dict[str, str], relationships: list[dict], seed: int = 0, log: Decisions | None = None) -> dict:
    """The blueprint of a dataset; relationships are dicts with from_table, foreign_key, to_table, to_column."""
    refs: dict[str, dict[str, str]] = {}
    for r in relationships:
        if r["from_table"] in tables and r["to_table"] in tables:
            refs.setdefault(r["from_table"], {})[r["foreign_key"]] = r["to_table"]
    return {"seed": seed, "tables": {n: learn_table(df, keys.get(n), refs.get(n), log=log, name=n) for n, df in tables.items()}, "relationships": relationships}
