"""Lineage of scripts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headwater.operators import lineage
from headwater.sources.corpus import stream_corpus


def lineage_stream(spark: SparkSession, path: str, output: str, checkpoint: str, dialect: str = "tsql"):
    """Starts a query that writes the statements of each new script below a folder to a Parquet table.

    Each batch has a folder of its own (batch=N), which a repeated batch overwrites, so every script is in the table once.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        lineage.analyze(df, dialect).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={batch_id}")

    return stream_corpus(spark, path, dialect).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
