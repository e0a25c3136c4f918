"""A log of outcomes that a stream adds to, from which partial snapshots are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def publish_outcomes(outcomes: DataFrame, path: str):
    """A sink that writes each micro-batch to the folder of its number. A batch that is run again after a failure replaces its own folder, so every outcome is there once; what earlier batches published stays."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return outcomes.writeStream.foreachBatch(write)


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All outcomes published so far."""
    return spark.read.schema(schema).parquet(path).drop("batch")
