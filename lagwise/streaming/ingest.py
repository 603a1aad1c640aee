"""Incremental ingest: files of observations as a stream, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.series import OBSERVATIONS, latest


def observation_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(OBSERVATIONS).format(fmt).load(path)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch with its number as load_seq; a batch that is run again writes the same partition."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/load_seq={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest value of each (variable_id, ts)."""
    return latest(spark.read.parquet(path), ["variable_id", "ts"])
