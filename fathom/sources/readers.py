"""Readers by format, directories of files as tables, companion schemas, and lookup lists."""

from __future__ import annotations

import json
import os
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl"}


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None, null: str = "") -> DataFrame:
    """Give a schema for large files: inferring one reads them twice."""
    reader = spark.read.options(sep=sep, header=header, nullValue=null, multiLine=False)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def read_json(spark: SparkSession, path: str, lines: bool = False, schema: str | None = None) -> DataFrame:
    """An array of objects, or one object per line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read(spark: SparkSession, path: str, limit: int | None = None, **options) -> DataFrame:
    """A file or folder by its suffix; an unknown one is an error."""
    kind = SUFFIXES.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind is None:
        raise ValueError(f"no reader for {path}")
    df = {"csv": read_csv, "tsv": read_tsv, "json": read_json, "jsonl": lambda s, p, **o: read_json(s, p, lines=True, **o), "parquet": lambda s, p, **o: s.read.options(**o).parquet(p)}[kind](spark, path, **options)
    return df.limit(limit) if limit is not None else df


def read_directory(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One table per file, and per folder with files: ``key=value`` parts of paths become columns. ``schema.json`` beside the files of a
    table is its companion schema."""
    groups: dict[tuple[str, str], list[str]] = defaultdict(list)
    for root, folders, files in os.walk(folder):
        folders.sort()
        for f in sorted(files):
            kind = SUFFIXES.get(os.path.splitext(f)[1].lower())
            if kind is None or f == "schema.json" or f.startswith(("_", ".")):
                continue
            parts = [p for p in os.path.relpath(root, folder).split(os.sep) if p not in (".", "")]
            plain = [p for p in parts if "=" not in p]
            groups[("/".join(plain) or os.path.splitext(f)[0], kind)].append(os.path.join(root, f))
    out = {}
    for (name, kind), files in groups.items():
        base = os.path.join(folder, name)
        partitioned = any("=" in p for p in os.path.relpath(os.path.dirname(files[0]), folder).split(os.sep))
        reader = spark.read.options(basePath=base) if partitioned else spark.read
        if kind in ("csv", "tsv"):
            df = reader.options(header=True, inferSchema=True, sep="\t" if kind == "tsv" else ",").csv(files)
        elif kind in ("json", "jsonl"):
            df = reader.option("multiLine", kind == "json").json(files)
        else:
            df = reader.parquet(*files)
        companion = os.path.join(base, "schema.json")
        out[name.replace("/", "_")] = apply_companion(df, json.load(open(companion))) if os.path.exists(companion) else df
    return out


def apply_companion(df: DataFrame, companion: dict) -> DataFrame:
    """{"types": {column: type}, "dictionaries": {column: {code: value}}, "row_type": {"column": c, "value": v}}: casts columns, decodes
    dictionary codes, and keeps the rows of one type where a file mixes several. Dictionaries are schema-sized."""
    row = companion.get("row_type")
    if row:
        df = df.where(F.col(row["column"]) == row["value"])
    for c, codes in companion.get("dictionaries", {}).items():
        pairs = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (str(k), str(v))])
        df = df.withColumn(c, F.coalesce(pairs[F.col(c).cast("string")], F.col(c).cast("string")))
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in companion.get("types", {}).items()})


def lookup_values(spark: SparkSession, path: str, column: str, weight: str | None = None, most: int = 100_000) -> tuple[list, list[float]]:
    """Values and weights of a list file. More than ``most`` values are an error: such a list is joined as a table instead."""
    df = read(spark, path).select(column, *([weight] if weight else [])).where(F.col(column).isNotNull())
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path} has more than {most} values; join it by row index instead")
    return [r[0] for r in rows], [float(r[1]) for r in rows] if weight else [1.0] * len(rows)


def with_lookup(df: DataFrame, index: str, lookup: DataFrame, order: list[str]) -> DataFrame:
    """Whole rows of a lookup table by a 0-based index column, for lists of any size."""
    from fathom.operators.relational import row_index

    return df.join(row_index(lookup, order, index), index, "left")
