"""Features of a live price stream, recomputed where new prices change them and merged by the number of the batch.

A price of a session changes the features of that session and of later ones; these rest on a bounded number of sessions
before. So each batch reads the touched instruments' tails only, and writes what changed under its own number: a batch that
runs again writes the same rows over its own, and readers take each row from its last batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import volatility

KEYS = ["instrument_id", "session_date"]
#: Sessions before a changed one on which its features rest: the benchmark's volatilities, each of 21 returns.
LOOKBACK = max(max(volatility.HORIZONS), volatility.BENCHMARK + max(h for h in volatility.HORIZONS if h <= 21)) + 1


def current(spark: SparkSession, root: str, name: str, upto: int | None = None) -> DataFrame | None:
    """Each row of a stored table from its last batch (of those up to one), or None where nothing is stored."""
    try:
        stored = spark.read.parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    stored = stored if upto is None else stored.filter(F.col("batch") <= upto)
    values = [c for c in stored.columns if c not in (*KEYS, "batch")]
    return stored.groupBy(*KEYS).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*KEYS, "_v.*")


def tail(prices: DataFrame, changed: DataFrame, lookback: int) -> DataFrame:
    """The touched instruments' prices from `lookback` sessions before their first changed one on, with that one as `first_changed`."""
    first = changed.groupBy("instrument_id").agg(F.min("session_date").alias("first_changed"))
    own = prices.join(first, "instrument_id").withColumn("_new", F.col("session_date") >= F.col("first_changed"))
    place = F.row_number().over(W.partitionBy("instrument_id", "_new").orderBy(F.col("session_date").desc()))
    return own.withColumn("_place", place).filter(F.col("_new") | (F.col("_place") <= lookback)).drop("_new", "_place")


def refresh(spark: SparkSession, root: str, batch: DataFrame, number: int, features: Callable[[DataFrame], DataFrame] = volatility.features, lookback: int = LOOKBACK) -> None:
    """Stores a batch of prices (instrument_id, session_date, price; of a session given twice the greatest price) and the features that it changes."""
    fresh = batch.groupBy(*KEYS).agg(F.max("price").alias("price"))
    fresh.write.mode("overwrite").parquet(f"{root}/prices/batch={number}")
    changed = spark.read.parquet(f"{root}/prices/batch={number}")
    if changed.isEmpty():
        return
    rows = tail(current(spark, root, "prices", number), changed, lookback)
    out = features(rows.select(*KEYS, "price")).join(rows.select(*KEYS, "first_changed"), KEYS).filter("session_date >= first_changed").drop("first_changed")
    out.write.mode("overwrite").parquet(f"{root}/features/batch={number}")


def follow(spark: SparkSession, root: str, prices: DataFrame):
    """Starts the stream over what its source holds now, in the source's batches; restarts go on where the last one ended."""
    writer = prices.select(*KEYS, "price").writeStream.foreachBatch(lambda frame, number: refresh(spark, root, frame, number))
    return writer.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
