"""Blueprints: models as plain dictionaries, read from TOML or JSON, composed, checked, compared and turned into other forms.

A model has ``seed``, ``tables`` (name -> count, fields, constraints), ``relationships``, ``params``, ``mixins`` and ``types``. All work here is on
the driver and on schema-sized data.
"""

from __future__ import annotations

import copy
import json
import re
import tomllib
from graphlib import CycleError
from pathlib import Path

from fathom.operators.generate.columns import GENERATORS
from fathom.operators.generate.engine import SPARK_TYPES, dependencies, layers
from fathom.operators.generate.wholes import WHOLES

SQL_TYPES = {"bool": "BOOLEAN", "int": "BIGINT", "int32": "INTEGER", "float": "DOUBLE", "string": "VARCHAR", "uuid": "VARCHAR", "date": "DATE", "datetime": "TIMESTAMP", "time": "BIGINT", "duration": "BIGINT", "bytes": "BLOB"}


def loads(text: str, kind: str = "toml") -> dict:
    return json.loads(text) if kind == "json" else tomllib.loads(text)


def load(path: str, seen: frozenset[str] = frozenset()) -> dict:
    """A blueprint file with its ``include`` files (each once, circles are errors) and its ``extends`` base; the file itself overrides both."""
    p = Path(path).resolve()
    if str(p) in seen:
        raise ValueError(f"include circle at {p}")
    own = loads(p.read_text(), "json" if p.suffix == ".json" else "toml")
    base: dict = {}
    for other in [*own.pop("include", []), *([own.pop("extends")] if "extends" in own else [])]:
        base = merge(base, load(str(p.parent / other), seen | {str(p)}))
    return expand(merge(base, own))


def merge(base: dict, over: dict) -> dict:
    """Nested dictionaries merged; the second wins."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def expand(model: dict) -> dict:
    """Mixins put in front of the fields of tables that name them, and custom types replaced by their definitions."""
    out = copy.deepcopy(model)
    for t in out.get("tables", {}).values():
        fields: dict = {}
        for m in t.pop("mixins", []):
            fields |= copy.deepcopy(out["mixins"][m]["fields"])
        t["fields"] = fields | t.get("fields", {})
        for name, f in t["fields"].items():
            while f.get("type") in out.get("types", {}):
                f = merge(out["types"][f["type"]], {k: v for k, v in f.items() if k != "type"})
            t["fields"][name] = f
    return out


def validate(model: dict) -> list[str]:
    """All errors of a model."""
    errors = []
    tables = model.get("tables", {})
    for n, t in tables.items():
        if not isinstance(t.get("count", 1), int) or t.get("count", 1) < 0:
            errors.append(f"{n}: count must be a non-negative whole number")
        for f, spec in t.get("fields", {}).items():
            if spec.get("type", "string") not in SPARK_TYPES and spec.get("type") not in ("array", "map", "object"):
                errors.append(f"{n}.{f}: unknown type {spec['type']}")
            g = spec.get("generator")
            if g and g.get("type") not in GENERATORS and g.get("type") not in WHOLES:
                errors.append(f"{n}.{f}: unknown generator {g.get('type')}")
            if g and g.get("type") == "fk" and g.get("parent") not in tables:
                errors.append(f"{n}.{f}: unknown parent {g.get('parent')}")
            rate = spec.get("null")
            if isinstance(rate, (int, float)) and not 0 <= rate <= 1:
                errors.append(f"{n}.{f}: a null rate lies between 0 and 1")
        try:
            layers(t.get("fields", {}))
        except CycleError as e:
            errors.append(f"{n}: fields depend on each other in a circle: {' -> '.join(e.args[1])}")
        except ValueError as e:
            errors.append(f"{n}: {e}")
    for r in model.get("relationships", []):
        for side, column in (("from_table", "foreign_key"), ("to_table", "to_column")):
            t = tables.get(r.get(side))
            if t is None:
                errors.append(f"relationship: unknown table {r.get(side)}")
            elif r.get(column) not in t.get("fields", {}):
                errors.append(f"relationship: {r[side]} has no field {r.get(column)}")
    return errors


def lint(model: dict) -> list[str]:
    """Things that work but may not be meant."""
    out = []
    for n, t in model.get("tables", {}).items():
        if not any(f.get("primary_key") for f in t.get("fields", {}).values()):
            out.append(f"{n}: no primary key")
        out += [f"{n}.{f}: no generator" for f, s in t.get("fields", {}).items() if "generator" not in s]
        if not t.get("count"):
            out.append(f"{n}: no rows")
    return out


def diff(a: dict, b: dict) -> list[str]:
    """Changes from a to b, as sorted paths."""

    def walk(x, y, path):
        if isinstance(x, dict) and isinstance(y, dict):
            for k in sorted(x.keys() | y.keys(), key=str):
                if k not in x:
                    yield f"+ {path}{k}"
                elif k not in y:
                    yield f"- {path}{k}"
                else:
                    yield from walk(x[k], y[k], f"{path}{k}.")
        elif x != y:
            yield f"~ {path[:-1]}: {x!r} -> {y!r}"

    return list(walk(a, b, ""))


def normalize(model: dict) -> dict:
    """The same model with sorted keys and defaults written out."""
    out = expand(model)
    for t in out.get("tables", {}).values():
        for f in t["fields"].values():
            f.setdefault("type", "string")
    return json.loads(json.dumps(out, sort_keys=True))


def subset(model: dict, names: list[str]) -> dict:
    """Some tables with the parents they need."""
    keep, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n in keep:
            continue
        keep.add(n)
        todo += [g["parent"] for f in model["tables"][n]["fields"].values() if (g := f.get("generator", {})).get("type") == "fk"]
        todo += [r["to_table"] for r in model.get("relationships", []) if r["from_table"] == n]
    return model | {"tables": {n: t for n, t in model["tables"].items() if n in keep}, "relationships": [r for r in model.get("relationships", []) if r["from_table"] in keep and r["to_table"] in keep]}


def rename(model: dict, table: str, new: str) -> dict:
    """A table renamed wherever it is named."""
    out = copy.deepcopy(model)
    out["tables"] = {(new if n == table else n): t for n, t in out["tables"].items()}
    for t in out["tables"].values():
        for f in t["fields"].values():
            if f.get("generator", {}).get("parent") == table:
                f["generator"]["parent"] = new
    for r in out.get("relationships", []):
        r |= {k: new for k in ("from_table", "to_table") if r[k] == table}
    return out


def stats(model: dict) -> dict:
    fields = [f for t in model["tables"].values() for f in t["fields"].values()]
    return {"tables": len(model["tables"]), "fields": len(fields), "rows": sum(t.get("count", 0) for t in model["tables"].values()), "relationships": len(model.get("relationships", [])), "generators": len({f["generator"]["type"] for f in fields if "generator" in f})}


def document(model: dict) -> str:
    """Markdown of tables and fields."""
    lines = ["# Model", ""]
    for n, t in model["tables"].items():
        lines += [f"## {n} ({t.get('count', 0)} rows)", "", "| field | type | generator |", "|---|---|---|", *[f"| {f} | {s.get('type', 'string')} | {s.get('generator', {}).get('type', '')} |" for f, s in t["fields"].items()], ""]
    return "\n".join(lines)


def graph(model: dict, form: str = "dot") -> str:
    """The tables and their references as Graphviz or Mermaid text."""
    edges = sorted({(r["from_table"], r["to_table"], r["foreign_key"]) for r in model.get("relationships", [])})
    if form == "mermaid":
        return "\n".join(["graph LR", *[f"  {a} -->|{k}| {b}" for a, b, k in edges]])
    return "\n".join(["digraph model {", *[f'  "{n}";' for n in model["tables"]], *[f'  "{a}" -> "{b}" [label="{k}"];' for a, b, k in edges], "}"])


def to_sql(model: dict) -> str:
    """CREATE TABLE statements."""
    out = []
    for n, t in model["tables"].items():
        cols = [f"  {f} {SQL_TYPES.get(s.get('type', 'string'), 'VARCHAR')}{' PRIMARY KEY' if s.get('primary_key') else ''}{' NOT NULL' if s.get('nullable') is False else ''}" for f, s in t["fields"].items()]
        cols += [f"  FOREIGN KEY ({r['foreign_key']}) REFERENCES {r['to_table']} ({r['to_column']})" for r in model.get("relationships", []) if r["from_table"] == n]
        out.append(f"CREATE TABLE {n} (\n" + ",\n".join(cols) + "\n);")
    return "\n\n".join(out)


def from_schema(name: str, schema, count: int = 1000) -> dict:
    """A first model of a table from its Spark schema."""
    kinds = {"bigint": "int", "int": "int32", "smallint": "int32", "double": "float", "float": "float", "string": "string", "boolean": "bool", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "binary": "bytes"}
    return {"seed": 0, "tables": {name: {"count": count, "fields": {f.name: {"type": kinds.get(f.dataType.simpleString(), "string"), "nullable": f.nullable} for f in schema.fields}}}}


def from_sql(ddl: str, count: int = 1000) -> dict:
    """A first model from CREATE TABLE statements: columns, keys and references."""
    kinds = {"int": "int", "integer": "int32", "bigint": "int", "smallint": "int32", "double": "float", "float": "float", "real": "float", "decimal": "float", "numeric": "float", "varchar": "string", "char": "string", "text": "string", "boolean": "bool", "bool": "bool", "date": "date", "timestamp": "datetime", "datetime": "datetime", "uuid": "uuid", "blob": "bytes"}
    model: dict = {"seed": 0, "tables": {}, "relationships": []}
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?(\w+)[\"`]?\s*\((.*?)\)\s*;", ddl, re.I | re.S):
        table, body = m.groups()
        fields: dict = {}
        for part in re.split(r",(?![^()]*\))", body):
            part = " ".join(part.split())
            if fk := re.match(r"(?:constraint \w+ )?foreign key \((\w+)\) references (\w+) \((\w+)\)", part, re.I):
                model["relationships"].append({"name": f"{table}_{fk[1]}", "from_table": table, "foreign_key": fk[1], "to_table": fk[2], "to_column": fk[3]})
            elif pk := re.match(r"primary key \((\w+)\)", part, re.I):
                fields[pk[1]]["primary_key"] = True
            elif col := re.match(r"[\"`]?(\w+)[\"`]? (\w+)", part):
                f = {"type": kinds.get(col[2].lower(), "string")}
                f |= {"primary_key": True} if re.search("primary key", part, re.I) else {}
                f |= {"nullable": False} if re.search("not null", part, re.I) else {}
                fields[col[1]] = f
                if ref := re.search(r"references (\w+) ?\((\w+)\)", part, re.I):
                    model["relationships"].append({"name": f"{table}_{col[1]}", "from_table": table, "foreign_key": col[1], "to_table": ref[1], "to_column": ref[2]})
        model["tables"][table] = {"count": count, "fields": fields}
    return model


def scaffold(name: str) -> dict:
    """A small working model to start from."""
    return {"seed": 1, "tables": {name: {"count": 100, "fields": {"id": {"type": "int", "primary_key": True, "generator": {"type": "sequence"}}, "label": {"type": "string", "generator": {"type": "faker", "kind": "word"}}}}}}


def dumps(model: dict) -> str:
    return json.dumps(model, indent=2, sort_keys=True)


def plan(model: dict) -> list[dict]:
    """The order in which fields are computed, per table."""
    return [{"table": n, "rows": t.get("count", 0), "layers": layers(t["fields"]), "reads": {f: sorted(r) for f, r in dependencies(t["fields"]).items() if r}} for n, t in model["tables"].items()]


def update(model: dict, changes: dict[str, object]) -> dict:
    """Values set at paths such as "tables.orders.count"; a value of None removes. Unknown parents are made."""
    out = copy.deepcopy(model)
    for path, value in changes.items():
        *above, last = path.split(".")
        at = out
        for p in above:
            at = at.setdefault(p, {})
        if value is None:
            at.pop(last, None)
        else:
            at[last] = value
    return out


def derive(model: dict, table: str, field: str, expression: str, kind: str = "float") -> dict:
    """A model with a field computed from others of its table; what it reads must be there, and no circle may arise."""
    out = update(model, {f"tables.{table}.fields.{field}": {"type": kind, "generator": {"type": "derived", "expression": expression}}})
    fields = out["tables"][table]["fields"]
    named = set(re.findall(r"\$\{([^}]*)\}", expression))
    if unknown := sorted(named - fields.keys()):
        raise ValueError(f"{table} has no fields {unknown}")
    layers(fields)
    return out


def sample(spark, model: dict, rows: int = 5) -> dict:
    """The first rows of each table, as dictionaries."""
    from fathom.operators.generate.engine import generate_table

    small = update(model, {f"tables.{n}.count": min(rows, t.get("count", 0)) for n, t in model["tables"].items() if n not in _parents(model)})
    return {n: [r.asDict() for r in generate_table(spark, small, n).limit(rows).collect()] for n in model["tables"]}


def _parents(model: dict) -> set[str]:
    return {f["generator"]["parent"] for t in model["tables"].values() for f in t["fields"].values() if f.get("generator", {}).get("type") == "fk"}


def test(spark, model: dict) -> list[str]:
    """What is wrong with a model when it is generated: errors of validate, and findings of the check of its own tables."""
    from fathom.operators.check import validate as check
    from fathom.operators.generate.engine import generate

    if errors := validate(model):
        return errors
    found = check(generate(spark, model), model).where("severity = 'error'").collect()
    return [f"{r.table_name}.{r.column_name}: {r.finding} ({r.n})" for r in found]


def inspect(model: dict, table: str, field: str | None = None) -> dict:
    """What a model says of a table or field, with what it reads and what refers to it."""
    t = model["tables"][table]
    reads = dependencies(t["fields"])
    if field is None:
        return {"table": table, "rows": t.get("count", 0), "fields": list(t["fields"]), "references": [r for r in model.get("relationships", []) if table in (r["from_table"], r["to_table"])]}
    return {"field": field, **t["fields"][field], "reads": sorted(reads[field]), "read_by": sorted(f for f, r in reads.items() if field in r)}


VERSION = 2


def info(model: dict) -> dict:
    return {"version": model.get("version", 1), **stats(model)}


def migrate(model: dict) -> dict:
    """A model of an earlier version in the present form: version 1 called tables entities and counts rows."""
    out = copy.deepcopy(model)
    if out.get("version", 1) < 2:
        if "entities" in out:
            out["tables"] = out.pop("entities")
        for t in out.get("tables", {}).values():
            if "rows" in t and "count" not in t:
                t["count"] = t.pop("rows")
    out["version"] = VERSION
    return out


def generators() -> list[str]:
    """The names of all generators."""
    return sorted({*GENERATORS, *WHOLES})
