"""A folder of files with its texts replaced by pseudonyms: every table is classified, read, mapped by one map, and written in its own format.

The listing goes through Hadoop's file system, so the folder may lie on any storage Spark reads. Which columns are mapped is a choice by name;
what the driver holds is of the size of the listing and of the schemas.
"""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators import pseudonymize
from fathom.session import checkpoint
from fathom.sources import readers, sinks

REPORT = "path string, kind string, rows long, columns array<string>"


def scan(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(path relative to the folder, kind) of all files; a folder of part files is one table, and a kind no reader knows is "other"."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], [(root, "")]
    while todo:
        at, name = todo.pop()
        for s in fs.listStatus(at):
            p, short = s.getPath(), s.getPath().getName()
            path = f"{name}/{short}".strip("/")
            if short.startswith(("_", ".")):
                continue
            kind = readers.SUFFIXES.get("." + short.rsplit(".", 1)[-1].lower() if "." in short else "", "other")
            if s.isDirectory() and kind == "other":
                todo.append((p, path))
            else:
                out.append((path, kind))
    return sorted(out)


def chosen(df: DataFrame, path: str, allow: list[str] | None, deny: list[str]) -> list[str]:
    """The text columns to map: those that a pattern of ``allow`` names (all if None) and none of ``deny``. Patterns are of a column, or of
    "path:column"."""
    named = lambda c, patterns: any(fnmatch(c, p) or fnmatch(f"{path}:{c}", p) for p in patterns)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return [c for c in texts if (allow is None or named(c, allow)) and not named(c, deny)]


def pseudonymize_folder(spark: SparkSession, folder: str, out: str, seed: int, allow: list[str] | None = None, deny: list[str] = [], headers: bool = False, **options) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Write the folder's tables to ``out`` with pseudonyms; returns the map (value, token) and a report (path, kind, rows, columns). With ``headers``
    names of columns are mapped as well. Files of other kinds are named in the report and not copied."""
    tables, picked = {}, {}
    files = scan(spark, folder)
    for path, kind in files:
        if kind != "other":
            tables[path] = readers.read(spark, f"{folder}/{path}")
            picked[path] = chosen(tables[path], path, allow, deny)
    sources = [(tables[p], c) for p, c in picked.items() if c]
    values = pseudonymize.distinct_values(sources, **options) if sources else spark.createDataFrame([], "value string")
    if headers:
        names = [(c,) for df in tables.values() for c in df.columns]
        values = values.unionByName(spark.createDataFrame(names, "value string").where(pseudonymize.eligible(F.col("value")))).distinct()
    mapping = checkpoint(pseudonymize.build_map(values, seed))
    renamed = {r.value: r.token for r in mapping.join(spark.createDataFrame([(c,) for c in {c for df in tables.values() for c in df.columns}] or [("",)], "value string"), "value").collect()} if headers else {}
    report = []
    for path, kind in files:
        if kind == "other":
            report.append((path, kind, None, []))
            continue
        made = pseudonymize.apply_map(tables[path], picked[path], mapping, **options)
        sinks.write(made.withColumnsRenamed(renamed), f"{out}/{path}", "jsonl" if kind == "json" else kind)
        report.append((path, kind, tables[path].count(), picked[path]))
    return mapping, spark.createDataFrame(report, REPORT)
