"""Series out of a star schema: orders by priority and status, events by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price of each priority and status by day. Prices are summed as whole cents, so the sum has no order."""
    o = table(spark, sf_dir, "orders")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    grouped = o.groupBy(F.concat_ws(":", F.lit("orders"), "o_orderpriority", "o_orderstatus").alias("variable_id"), F.col("o_orderdate").cast("date").alias("ts"))
    return grouped.agg((cents / F.lit(100.0) / F.count("*")).alias("value"))


def order_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of those series; the name is made of priority and status words."""
    obs = order_observations(spark, sf_dir).groupBy("variable_id").agg(F.count("*").alias("observations"), F.min("ts").alias("start_date"), F.max("ts").alias("end_date"))
    part = F.split("variable_id", ":")
    name = F.concat(F.lit("mean order price "), F.lower(part[1]), F.lit(" status "), F.lower(part[2]))
    return obs.select("variable_id", part[0].alias("source"), name.alias("name"), F.lit("daily").alias("frequency"), F.lit(None).cast("string").alias("unit"), part[2].alias("geo"), "observations", "start_date", "end_date")
