"""Daily price series from order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per order priority: each day's price is that of its greatest order key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.to_date("o_orderdate").alias("session_date")
    return orders.groupBy(F.col("o_orderpriority").alias("instrument_id"), day).agg(F.max_by("o_totalprice", "o_orderkey").alias("price"))
