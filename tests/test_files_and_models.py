import json
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.operators import blueprint, check, enrich, pseudonymize, scale
from fathom.sources import readers, sinks
from fathom.streaming import state_stream


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, 1.5, "a'b", True, None), (2, None, 'q"x', False, [1, 2]), (3, -2.0, None, None, [])], "id long, score double, label string, active boolean, tags array<long>")


def test_round_trips(spark, df, tmp_path):
    want = sorted(map(str, df.collect()))
    for kind in ("parquet", "jsonl", "json"):
        path = str(tmp_path / f"t.{kind}")
        sinks.write(df, path, kind)
        back = spark.read.schema(df.schema)
        got = back.parquet(path) if kind == "parquet" else back.option("multiLine", kind == "json").json(path)
        assert sorted(map(str, got.collect())) == want, kind
    sinks.write(df, str(tmp_path / "t.csv"), "csv", null="NULL")
    got = readers.read(spark, str(tmp_path / "t.csv"), schema="id long, score double, label string, active boolean, tags string", null="NULL")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3] and got.where("label is null").count() == 1
    sinks.write(df, str(tmp_path / "t.ipc"), "ipc")
    rows = sum(pa.ipc.open_file(p).read_all().num_rows for p in (tmp_path / "t.ipc").glob("*.arrow"))
    assert rows == 3
    with pytest.raises(ValueError):
        sinks.write(df, "x", "nope")
    with pytest.raises(RuntimeError):
        sinks.write(df.drop("tags"), str(tmp_path / "t.avro"), "avro")


def test_sql_and_templates(df):
    got = [r.value for r in sinks.sql_inserts(df.drop("tags").coalesce(1), "t", rows_per_insert=2).collect()]
    assert got[0] == "BEGIN;" and got[-1] == "COMMIT;" and got[1] == "INSERT INTO t (id, score, label, active) VALUES\n(1, 1.5, 'a''b', TRUE),\n(2, NULL, 'q\"x', FALSE);" and len(got) == 4
    assert sinks.create_table_sql(df.select("id", "label"), "t") == "CREATE TABLE t (id BIGINT, label VARCHAR);"
    assert sorted(r.value for r in sinks.rendered(df, "{id|pad_left:3}-{label|upper}").collect()) == ["  1-A'B", '  2-Q"X', "  3-"]
    kept = sinks.with_missing_fields(df, 1.0, 1, "id", ["label"])
    assert kept.where("label is not null").count() == 0


def test_directory_ingest(spark, tmp_path):
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(str(tmp_path / "big"))
    (tmp_path / "small.csv").write_text("code,n\nA,1\nB,2\n")
    (tmp_path / "notes.txt").write_text("x")
    got = readers.read_directory(spark, str(tmp_path))
    assert set(got) == {"big", "small"} and got["big"].columns == ["id", "p"] and got["big"].count() == 4
    assert readers.lookup_values(spark, str(tmp_path / "small.csv"), "code", "n") == (["A", "B"], [1.0, 2.0])
    with pytest.raises(ValueError):
        readers.lookup_values(spark, str(tmp_path / "small.csv"), "code", most=1)
    with pytest.raises(ValueError):
        readers.read(spark, str(tmp_path / "notes.txt"))
    coded = readers.apply_companion(got["small"], {"dictionaries": {"code": {"A": "alpha"}}, "types": {"n": "string"}, "row_type": {"column": "n", "value": 1}})
    assert [tuple(r) for r in coded.collect()] == [("alpha", "1")]


def test_stream_of_chunks(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "state")
    spark.range(100).selectExpr("cast(id % 2 as int) as chunk", "double(id) as x").write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        q = state_stream.learn_stream(spark.readStream.schema("chunk int, x double").parquet(src), "chunk", "t", path, str(tmp_path / "cp"))
        q.awaitTermination()
    r = state_stream.current(spark, path).where("column_name = 'x'").first()
    assert (r.rows, r.mean) == (100, 49.5)
    state_stream.add_batch(spark.createDataFrame([(0, 9e9)], "chunk int, x double"), 7, "chunk", "t", path)
    assert state_stream.current(spark, path).where("column_name = 'x'").first().rows == 100
    timed = spark.readStream.schema("t timestamp, k string").parquet(src)
    assert state_stream.windowed_counts(timed, "t", by=["k"]).isStreaming


def test_pseudonyms(spark):
    df = spark.createDataFrame([("Alice-12", "x"), ("Bob", "Bob"), (None, ""), ("true", "7"), ("Alice-12", "2024-01-02")] + [(chr(97 + i), "z") for i in range(26)], "a string, b string")
    values = pseudonymize.distinct_values([(df, ["a", "b"])])
    m = pseudonymize.build_map(values, 3)
    rows = m.collect()
    assert len({r.token for r in rows}) == len(rows) == values.count() and all(r.token != r.value for r in rows)
    there = pseudonymize.apply_map(df, ["a", "b"], m)
    assert sorted(map(str, pseudonymize.restore_map(there, ["a", "b"], m).collect())) == sorted(map(str, df.collect()))
    got = there.where("b = 'z'").count()
    assert got == 0 and there.where("a = 'true' and b = '7'").count() == 1
    n = spark.createDataFrame([(2**63 - 1, date(2024, 2, 29), "29.02.2024", 1.5)], "i long, d date, t string, f double")
    s = pseudonymize.shift_text_dates(pseudonymize.shift_dates(pseudonymize.shift_numbers(n, ["i", "f"], 77), ["d"], 400), ["t"], 400)
    back = pseudonymize.shift_text_dates(pseudonymize.shift_dates(pseudonymize.shift_numbers(s, ["i", "f"], -77), ["d"], -400), ["t"], -400)
    assert back.first() == n.first() and s.first().i < 0 and s.first().t == "04.04.2025"
    assert all(0 < abs(pseudonymize.day_shift(x)) <= 1825 and 0 < abs(pseudonymize.number_shift(x)) <= 10_000 for x in range(50))
    assert pseudonymize.build_map(values.limit(0), 3).count() == 0


def test_checks_and_scores(spark):
    a = spark.createDataFrame([(1, 5), (1, None), (None, 9)], "id long, ref long")
    b = spark.createDataFrame([(5,)], "id long")
    model = {"tables": {"a": {"rows": (5, 9), "fields": {"id": {"type": "int", "primary_key": True}, "gone": {"type": "int"}, "ref": {"type": "string"}}}, "c": {"fields": {}}}, "relationships": [{"from_table": "a", "foreign_key": "ref", "to_table": "b", "to_column": "id"}]}
    got = {(r.column_name, r.finding): r.n for r in check.validate({"a": a, "b": b}, model).collect()}
    assert got == {("gone", "missing_column"): 1, ("ref", "incompatible_type"): 1, (None, "missing_table"): 1, ("id", "null_primary_key"): 1, ("id", "duplicate_primary_key"): 1, (None, "row_count_out_of_range"): 1, ("ref", "orphan_reference"): 1}
    assert check.fk_integrity(a, "ref", b, "id").first().score == 0.5 and check.fk_integrity(a.limit(0), "ref", b, "id").first().score == 1.0
    same = check.compare_columns(a, a, ["id"], ["ref"])
    assert all(r.score == 1 for r in same.collect())
    assert check.final_score({"schema": 1, "nulls": 1, "distribution": 0.5}) == pytest.approx((0.2 + 0.1 + 0.2) / 0.7)


def test_scaling(spark):
    assert scale.steps(date(2024, 1, 31), date(2024, 4, 30), "month_end") == [date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31), date(2024, 4, 30)]
    assert scale.steps(date(2024, 1, 30), date(2024, 3, 30), "months") == [date(2024, 1, 30), date(2024, 2, 29), date(2024, 3, 30)]
    assert scale.new_values(["3", "7"], 2) == ["8", "9"] and scale.new_values(["Store 01", "Store 02"], 1) == ["Store 03"] and scale.new_values(["A", "B"], 1) == ["C"] and scale.new_values(["red"], 2) == ["red_2", "red_3"]
    assert enrich.greedy([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.7), ("b", "y", 0.6)]) == [("a", "x", 0.9), ("b", "y", 0.6)]
    assert enrich.quality(1, 0, 2000) == 1.0 and enrich.words("custAddr") == "customer_address"


def test_blueprints(tmp_path, spark):
    (tmp_path / "base.toml").write_text('seed = 1\n[types.money]\ntype = "float"\nprecision = 2\n[mixins.audit.fields.made]\ntype = "datetime"\n[tables.shop]\ncount = 3\n[tables.shop.fields.id]\ntype = "int"\nprimary_key = true\n')
    (tmp_path / "main.toml").write_text('include = ["base.toml"]\nseed = 5\n[[relationships]]\nname = "r"\nfrom_table = "sale"\nforeign_key = "shop_id"\nto_table = "shop"\nto_column = "id"\n[tables.sale]\ncount = 9\nmixins = ["audit"]\n[tables.sale.fields.price]\ntype = "money"\n[tables.sale.fields.shop_id]\ntype = "int"\ngenerator = {type = "fk", parent = "shop"}\n')
    m = blueprint.load(str(tmp_path / "main.toml"))
    assert m["seed"] == 5 and list(m["tables"]["sale"]["fields"]) == ["made", "price", "shop_id"] and m["tables"]["sale"]["fields"]["price"] == {"type": "float", "precision": 2}
    assert blueprint.validate(m) == [] and len(blueprint.lint(m)) == 4
    (tmp_path / "base.toml").write_text('include = ["main.toml"]')
    with pytest.raises(ValueError):
        blueprint.load(str(tmp_path / "main.toml"))
    bad = blueprint.merge(m, {"tables": {"sale": {"count": -1, "fields": {"price": {"type": "odd", "generator": {"type": "nope"}, "null": 2}, "x": {"generator": {"type": "derived", "expression": "${y}"}}, "y": {"generator": {"type": "derived", "expression": "${x}"}}}}}})
    assert len(blueprint.validate(bad)) == 5
    assert set(blueprint.subset(m, ["sale"])["tables"]) == {"sale", "shop"} and set(blueprint.subset(m, ["shop"])["tables"]) == {"shop"}
    renamed = blueprint.rename(m, "shop", "store")
    assert renamed["tables"]["sale"]["fields"]["shop_id"]["generator"]["parent"] == "store" and renamed["relationships"][0]["to_table"] == "store"
    assert blueprint.diff(m, renamed) and blueprint.diff(m, m) == []
    assert blueprint.stats(m) == {"tables": 2, "fields": 4, "rows": 12, "relationships": 1, "generators": 1}
    again = blueprint.from_sql(blueprint.to_sql(m))
    assert again["relationships"][0]["to_table"] == "shop" and again["tables"]["shop"]["fields"]["id"]["primary_key"]
    assert '"sale" -> "shop"' in blueprint.graph(m) and "sale -->" in blueprint.graph(m, "mermaid") and "## sale" in blueprint.document(m)
    assert json.loads(blueprint.dumps(blueprint.normalize(m)))["seed"] == 5 and blueprint.validate(blueprint.scaffold("t")) == [] and blueprint.plan(m)[0]["layers"]
    assert blueprint.from_schema("t", spark.range(1).schema)["tables"]["t"]["fields"]["id"]["type"] == "int"
    assert scale.rewrite(m, {"sale": 90})["tables"]["sale"]["count"] == 90
