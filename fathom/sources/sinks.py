"""Writers by format. All write from the tasks; nothing passes through the driver but one array bracket of the JSON form."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.rng import Rng


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_by: list[str] = []) -> None:  # noqa: B006
    df.write.mode("overwrite").partitionBy(*partition_by).option("compression", compression).parquet(path)


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, for formats without nesting."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, null: str = "", timestamps: str = "yyyy-MM-dd HH:mm:ss") -> None:
    flattened(df).write.mode("overwrite").options(sep=sep, header=header, nullValue=null, timestampFormat=timestamps, timestampNTZFormat=timestamps).csv(path)


def with_missing_fields(df: DataFrame, rate: float, seed: int, key: str, columns: list[str]) -> DataFrame:
    """Fields nulled at random; with write_json's default such keys are left out of their objects."""
    rng = Rng(seed, "missing_field", F.col(key).cast("string"))
    return df.withColumns({c: F.when(rng.uniform(c) >= rate, F.col(c)) for c in columns})


def write_json(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    """One object per line."""
    df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def write_json_array(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    """A folder of files that each hold one array of objects, written by the tasks."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": str(not keep_nulls).lower()})

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for b in batches:
            if len(b):
                lines = [("[" if first and i == 0 else ",") + v for i, v in enumerate(b["value"])]
                first = False
                yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    df.select(text.alias("value")).mapInPandas(arrays, "value string").write.mode("overwrite").text(path)


def write_ipc(df: DataFrame, path: str) -> None:
    """Arrow IPC files, one per task, in a folder that all executors reach. A task writes under a name of its own attempt and renames it at its
    end, so a repeated task leaves no half file."""
    os.makedirs(path, exist_ok=True)

    def save(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        c = TaskContext.get()
        final = os.path.join(path, f"part-{c.partitionId():05d}.arrow")
        part, writer, n = f"{final}.{c.taskAttemptId()}", None, 0
        for b in batches:
            writer = writer or pa.ipc.new_file(part, b.schema)
            writer.write_batch(b)
            n += b.num_rows
        if writer:
            writer.close()
            os.replace(part, final)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([n], pa.int64())})

    df.mapInArrow(save, "rows long").agg(F.sum("rows")).collect()


def write_avro(df: DataFrame, path: str, compression: str = "snappy") -> None:
    """Needs Spark's Avro package on the class path."""
    try:
        df.write.mode("overwrite").format("avro").option("compression", compression).save(path)
    except Exception as e:
        if "avro" in str(e).lower():
            raise RuntimeError("the Avro data source is not on the class path; start Spark with its spark-avro package") from e
        raise


def _literal(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "TRUE").otherwise("FALSE")
    elif isinstance(kind, T.NumericType):
        text = c.cast("string")
    else:
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), "NULL").otherwise(text)


SQL_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "float": "REAL", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def create_table_sql(df: DataFrame, table: str) -> str:
    return f"CREATE TABLE {table} ({', '.join(f'{c} {SQL_NAMES.get(k, "VARCHAR")}' for c, k in df.dtypes)});"


def sql_inserts(df: DataFrame, table: str, rows_per_insert: int = 100, transaction: bool = True) -> DataFrame:
    """(value) INSERT statements, each of up to ``rows_per_insert`` rows of one task; a task's statements are one transaction."""
    flat = flattened(df)
    values = F.concat(F.lit("("), F.concat_ws(", ", *[_literal(f.name, f.dataType) for f in flat.schema.fields]), F.lit(")"))
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES\n"

    def statements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, opened = [], False
        for b in batches:
            held += list(b["value"])
            full = len(held) // rows_per_insert
            if full:
                out = [head + ",\n".join(held[i * rows_per_insert : (i + 1) * rows_per_insert]) + ";" for i in range(full)]
                held = held[full * rows_per_insert :]
                yield pd.DataFrame({"value": (["BEGIN;"] if transaction and not opened else []) + out})
                opened = True
        out = [head + ",\n".join(held) + ";"] if held else []
        if transaction and (opened or out):
            out = ([] if opened else ["BEGIN;"]) + out + ["COMMIT;"]
        yield pd.DataFrame({"value": out})

    return flat.select(values.alias("value")).mapInPandas(statements, "value string")


def write_sql(df: DataFrame, path: str, table: str, **options) -> None:
    sql_inserts(df, table, **options).write.mode("overwrite").text(path)


#: Helpers of row templates: name -> column maker.
HELPERS = {
    "upper": lambda c: F.upper(c.cast("string")), "lower": lambda c: F.lower(c.cast("string")), "json": lambda c: F.to_json(F.struct(c.alias("v"))),
    "date": lambda c, form="yyyy-MM-dd": F.date_format(c, form), "number": lambda c, digits="2": F.format_number(c, int(digits)),
    "pad_left": lambda c, n="10": F.lpad(c.cast("string"), int(n), " "), "pad_right": lambda c, n="10": F.rpad(c.cast("string"), int(n), " "),
    "escape": lambda c: F.regexp_replace(c.cast("string"), r'(["\\])', r"\\$1"),
}


def rendered(df: DataFrame, template: str) -> DataFrame:
    """(value) one text per row: ``{field}`` and ``{field|helper:argument}`` are filled in, nulls as empty texts."""
    parts = []
    for piece in re.split(r"(\{[^{}]+\})", template):
        if piece.startswith("{") and piece.endswith("}"):
            name, *calls = piece[1:-1].split("|")
            c = F.col(f"`{name.strip()}`")
            for call in calls:
                helper, _, argument = call.partition(":")
                c = HELPERS[helper.strip()](c, *([argument] if argument else []))
            parts.append(F.coalesce(c.cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return df.select(F.concat(*parts).alias("value"))


def write_template(df: DataFrame, path: str, template: str) -> None:
    rendered(df, template).write.mode("overwrite").text(path)


WRITERS = {"parquet": write_parquet, "csv": write_csv, "tsv": lambda d, p, **o: write_csv(d, p, sep="\t", **o), "jsonl": write_json, "json": write_json_array, "ipc": write_ipc, "avro": write_avro, "sql": write_sql, "template": write_template}


def write(df: DataFrame, path: str, kind: str, **options) -> None:
    if kind not in WRITERS:
        raise ValueError(f"no writer for {kind}")
    WRITERS[kind](df, path, **options)
