import pytest
from pyspark.sql import functions as F

from fathom.operators import blueprint, check, pseudonymize, pseudonymize_files
from fathom.operators.generate import engine
from fathom.operators.learn import behavior, fit, keys
from fathom.operators.learn.decisions import Decisions


def model(parent_key, child=None, **more):
    tables = {"p": {"count": 300, "fields": {"id": parent_key | {"primary_key": True}, "w": {"type": "float", "generator": {"type": "distribution", "family": "pareto"}}}}, "c": {"count": 2000, "fields": {"r": {"type": parent_key["type"], "generator": {"type": "fk", "parent": "p", **(child or {})}}}}}
    return {"seed": 3, "tables": tables, **more}


KEYS = {
    "sequence": {"type": "int", "generator": {"type": "sequence", "start": 50, "step": 3}},
    "padded": {"type": "string", "generator": {"type": "sequence", "prefix": "K", "width": 6}},
    "text of a number": {"type": "string", "generator": {"type": "sequence"}},
    "uuid": {"type": "uuid", "generator": {"type": "uuid"}},
    "scattered": {"type": "int", "generator": {"type": "unique_int", "low": 1, "high": 1000}},
    "unique": {"type": "string", "generator": {"type": "unique", "of": {"type": "pattern", "pattern": "A#"}}},
    "derived": {"type": "string", "generator": {"type": "derived", "expression": "concat(\"x\", cast_string(${w}))"}},
}


@pytest.mark.parametrize("kind", KEYS)
def test_references_to_any_key_exist(spark, kind):
    for child in ({}, {"selection": "sequential"}, {"selection": "zipf"}, {"weight_field": "w"}):
        m = model(KEYS[kind], child)
        p, c = engine.generate_table(spark, m, "p"), engine.generate_table(spark, m, "c")
        assert c.count() == 2000 and c.join(p, c["r"] == p["id"], "left_anti").count() == 0
        if child:
            continue
        assert p.select("id").distinct().count() == 300 and check.fk_integrity(c, "r", p, "id").first().score == 1.0
        assert check.fk_integrity(c.withColumn("r", F.lit("none")), "r", p.withColumn("id", F.col("id").cast("string")), "id").first().score == 0.0
        assert check.fk_integrity(c.limit(0), "r", p, "id").first().score == 1.0


def test_edge_properties_and_copulas(spark):
    m = model(KEYS["sequence"], relationships=[{"from_table": "c", "foreign_key": "r", "to_table": "p", "to_column": "id", "properties": [{"name": "since", "type": "int", "generator": {"type": "constant", "value": 7}}]}])
    m["tables"]["c"]["fields"] |= {k: {"type": "float", "generator": {"type": "distribution", "family": "normal"}} for k in ("a", "b")}
    m["tables"]["c"]["copulas"] = [{"columns": ["a", "b"], "matrix": [[1.0, 0.9], [0.9, 1.0]]}]
    c = engine.generate_table(spark, m, "c")
    assert c.where("since = 7").count() == 2000 and c.agg(F.corr("a", "b")).first()[0] > 0.85


def test_edges_as_rows(spark):
    m = model(KEYS["uuid"], graphs={"g": {"kind": "small_world", "actor": "p", "k": 4, "beta": 0.1}})
    m["tables"]["e"] = {"count": 0, "edges": {"graph": "g", "mean": 1.5}, "fields": {"id": {"type": "int", "generator": {"type": "sequence"}}, "a": {"type": "string", "generator": {"type": "edge_end"}}, "b": {"type": "string", "generator": {"type": "edge_end", "side": "target"}}}}
    e, p = engine.generate_table(spark, m, "e"), engine.generate_table(spark, m, "p")
    assert 500 < e.count() < 1300 and e.select("id").distinct().count() == e.count() and not e.where("a = b").count()
    assert e.join(p, e["b"] == p["id"], "left_anti").count() == 0


def test_pseudonyms_of_small_shapes(spark):
    values = [(chr(65 + i),) for i in range(26)] + [("Zoë",), ("Ünal",), ("日本",), ("a1",)]
    made = {r.value: r.token for r in pseudonymize.build_map(spark.createDataFrame(values, "value string"), 4).collect()}
    assert len(set(made.values())) == len(values) and not [v for v, t in made.items() if v in t]
    assert {made[chr(65 + i)] for i in range(26)} == {chr(65 + i) for i in range(26)} and "ë" not in made["Zoë"]


def test_missing_pseudonyms_never_pass(spark):
    df = spark.createDataFrame([("Anna",), (None,), ("12",)], "v string")
    m = spark.createDataFrame([("Bert", "Qxyz")], "value string, token string")
    with pytest.raises(Exception, match="no pseudonym"):
        pseudonymize.apply_map(df, ["v"], m).collect()
    assert [r.v for r in pseudonymize.apply_map(df, ["v"], m, missing="mask").collect()] == [pseudonymize.MASK, None, "12"]


def test_a_folder_of_files(spark, tmp_path):
    people = spark.createDataFrame([("Alice", "Seattle", 3), ("Bob", "Portland", 4)], "name string, city string, age int")
    people.coalesce(1).write.parquet(str(tmp_path / "in/a/people.parquet"))
    people.select("name").coalesce(1).write.option("header", True).csv(str(tmp_path / "in/names.csv"))
    (tmp_path / "in/notes.bin").write_bytes(b"x")
    mapping, report = pseudonymize_files.pseudonymize_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), 5, deny=["city"])
    got = {r.path: (r.kind, r.rows, list(r.columns)) for r in report.collect()}
    assert got == {"a/people.parquet": ("parquet", 2, ["name"]), "names.csv": ("csv", 2, ["name"]), "notes.bin": ("other", None, [])}
    out = spark.read.parquet(str(tmp_path / "out/a/people.parquet"))
    assert not {r.name for r in out.collect()} & {"Alice", "Bob"} and {r.city for r in out.collect()} == {"Seattle", "Portland"}
    back = pseudonymize.restore_map(out, ["name"], mapping)
    assert sorted(back.collect()) == sorted(people.collect())


def test_distribution_functions():
    import numpy as np

    one = np.ones(3)
    assert np.allclose(fit.gamma_cdf(np.array([0.5, 1.0, 9.0]), one, one), 1 - np.exp([-0.5, -1.0, -9.0]))
    assert np.allclose(fit.beta_cdf(np.array([0.1, 0.5, 0.9]), 2 * one, one), np.array([0.01, 0.25, 0.81]))
    assert np.allclose(fit.gamma_cdf(np.array([1.0, 4.0]), np.array([2.0, 2.0]), np.array([1.0, 2.0])), [1 - 2 / np.e, 1 - 3 / np.e**2])


def test_keys_actors_and_decisions(spark):
    found = [{"table_name": "cat", "column_name": c, "is_key": True} for c in ("x_id", "cat_id", "a_id")]
    assert keys.chosen_key(found, "cat") == "cat_id" and keys.chosen_key([*found, {"table_name": "cat", "column_name": "id", "is_key": True}], "cat") == "id" and keys.chosen_key([], "cat") is None
    assert keys.name_score("categoryID", "categories") == 0.9 and keys.name_score("supplierID", "suppliers") == 0.9 and keys.looks_like_id("orderKey")
    groups = behavior.actor_registry({"orders": ["user_id", "total"], "posts": ["author_id"]}, [{"from_table": "orders", "foreign_key": "user_id", "to_table": "users", "to_column": "id"}, {"from_table": "posts", "foreign_key": "author_id", "to_table": "users", "to_column": "id"}])
    assert groups == [[("orders", "user_id"), ("posts", "author_id"), ("users", "id")]]
    log = Decisions()
    from fathom.operators.learn import assemble

    assemble.learn_model({"t": spark.range(300).select("id", (F.col("id") * 1.5).alias("x"))}, {"t": "id"}, [], log=log)
    assert {(r.column_name, r.chosen) for r in log.frame(spark).collect()} == {("id", "sequence"), ("x", "distribution")}


def test_blueprint_commands(spark):
    m = model(KEYS["sequence"])
    assert blueprint.update(m, {"tables.p.count": 5})["tables"]["p"]["count"] == 5 and "w" not in blueprint.update(m, {"tables.p.fields.w": None})["tables"]["p"]["fields"]
    d = blueprint.derive(m, "p", "double_w", "${w} * 2")
    assert engine.generate_table(spark, d, "p").where("abs(double_w - 2 * w) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        blueprint.derive(m, "p", "y", "${nope} + 1")
    assert {n: len(r) for n, r in blueprint.sample(spark, m, 3).items()} == {"p": 3, "c": 3} and blueprint.test(spark, m) == []
    assert blueprint.inspect(d, "p", "w")["read_by"] == ["double_w"] and blueprint.info(blueprint.migrate({"entities": {"a": {"rows": 4, "fields": {}}}}))["rows"] == 4
    assert {"fk", "tuple_lookup", "uuid"} <= set(blueprint.generators())


def test_every_kind_of_text(spark):
    from fathom.operators.generate import columns

    kinds = [*columns.FAKES, *columns.ALIASES]
    ctx = {k: columns.Context(1, "t", k, 20) for k in kinds}
    row = engine.row_source(spark, 20).select(*[F.count(columns.faker(ctx[k], k).cast("string")).alias(k) for k in kinds]).first()
    assert len(kinds) >= 85 and all(row[k] == 20 for k in kinds)
