"""Incremental learning over a stream: every micro-batch adds the partials of its chunks to a state table.

The state is a Parquet folder partitioned by batch. A batch overwrites its own partition, so a repeated batch changes nothing, and a chunk that an
earlier batch has brought is skipped. Readers merge what is there at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.operators.learn import state


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def add_batch(batch: DataFrame, batch_id: int, chunk: str, table: str, path: str) -> None:
    """Write the partials of one micro-batch."""
    spark = batch.sparkSession
    fresh = state.partials(batch, chunk, table)
    if _exists(spark, path):
        known = spark.read.parquet(path).where(F.col("batch") != batch_id).select("table_name", "chunk").distinct()
        fresh = fresh.join(known, ["table_name", "chunk"], "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def learn_stream(stream: DataFrame, chunk: str, table: str, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the query; with ``available_now`` it ends when all files that are there have been read."""
    writer = stream.writeStream.foreachBatch(lambda b, i: add_batch(b, i, chunk, table, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The merged profile of all chunks so far."""
    return state.merged(spark.read.parquet(path).drop("batch"))


def windowed_counts(stream: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour", by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows per tumbling window and group; rows later than ``late`` are dropped, and finished windows leave the state."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))
