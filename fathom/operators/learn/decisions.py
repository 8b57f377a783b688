"""Why learning decided as it did: one record per decision, of the size of the schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "table_name string, column_name string, kind string, chosen string, reason string, confidence double"


@dataclass
class Decisions:
    records: list[tuple] = field(default_factory=list)

    def add(self, table: str, column: str | None, kind: str, chosen: str, reason: str, confidence: float | None = None) -> None:
        self.records.append((table, column, kind, chosen, reason, confidence))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, SCHEMA)
