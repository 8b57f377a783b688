"""Queries that go all the way round: files written and read back, and models learned, generated and scored."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import check
from fathom.operators.generate import engine
from fathom.operators.learn import assemble
from fathom.session import checkpoint_folder
from fathom.sources import readers, sinks
from fathom.sources.tables import table

SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


def _back(kind: str, suffix: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{checkpoint_folder(spark)}/file-{uuid.uuid4().hex}.{suffix}"
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
        sinks.write(o, path, kind)
        return readers.read(spark, path, **options)

    return run


_KEYS = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}
_LINKS = [{"name": "customer_nation", "from_table": "customer", "foreign_key": "c_nationkey", "to_table": "nation", "to_column": "n_nationkey"}, {"name": "orders_customer", "from_table": "orders", "foreign_key": "o_custkey", "to_table": "customer", "to_column": "c_custkey"}]


def _model(spark: SparkSession, sf_dir: str) -> dict:
    return assemble.learn_model({n: table(spark, sf_dir, n) for n in _KEYS}, _KEYS, _LINKS, seed=3)


def learn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator that stands for each learned column."""
    m = _model(spark, sf_dir)
    rows = [(t, f, s["type"], s["generator"]["type"], json.dumps(s["generator"], sort_keys=True)) for t, d in m["tables"].items() for f, s in d["fields"].items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, generator string, options string")


def learn_regenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A learned model generated again, and how close its orders and customers are to the original."""
    made = engine.generate(spark, _model(spark, sf_dir))
    out = check.compare_columns(table(spark, sf_dir, "orders"), made["orders"], ["o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    out = out.unionByName(check.compare_columns(table(spark, sf_dir, "customer"), made["customer"], ["c_acctbal"], ["c_mktsegment"]))
    keys = check.fk_integrity(made["orders"], "o_custkey", made["customer"], "c_custkey").select(F.lit("o_custkey").alias("column_name"), F.lit("fk").alias("measure"), "score")
    return out.unionByName(keys).withColumn("score", F.round("score", 4))


QUERIES = {
    "scan_csv": _back("csv", "csv", schema=SCHEMA),
    "scan_tsv": _back("tsv", "tsv", schema=SCHEMA),
    "scan_json": _back("json", "json", schema=SCHEMA),
    "scan_jsonl": _back("jsonl", "jsonl", schema=SCHEMA),
    "scan_parquet": _back("parquet", "parquet"),
    "learn_model": learn_model,
    "learn_regenerate": learn_regenerate,
}
SQL = dict.fromkeys(("scan_csv", "scan_tsv", "scan_json", "scan_jsonl", "scan_parquet"), "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
