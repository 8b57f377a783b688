"""Queries that run a stream to its end, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.session import checkpoint_folder
from fathom.sources.tables import table
from fathom.streaming import state_stream


def stream_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of requests learned by a stream over its files, one state chunk per load. State and progress lie in the shared folder."""
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    columns = ["load_id", "response_time_ms", "bytes_sent", "status_code"]
    schema = table(spark, sf_dir, "requests").select(*columns).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/requests.parquet*")
    state_stream.learn_stream(stream, "load_id", "requests", f"{base}/state", f"{base}/progress").awaitTermination()
    merged = state_stream.current(spark, f"{base}/state")
    return merged.select("table_name", "column_name", "rows", *[F.round(c, 4).alias(c) for c in ("null_rate", "mean", "std", "low", "high")])


QUERIES = {"stream_learn": stream_learn}

SQL = {
    "stream_learn": " union all ".join(
        f"select 'requests' table_name, '{c}' column_name, count(*) as \"rows\", round((count(*) - count({c})) / count(*), 4) null_rate, round(avg({c}), 4) mean, round(stddev_samp({c}), 4) std, cast(min({c}) as double) low, cast(max({c}) as double) high from requests"
        for c in ("response_time_ms", "bytes_sent", "status_code")
    )
}
