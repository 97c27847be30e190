"""Quotes as streams: numbers for accepted quotes, the last quote, and closes of sessions; and runs of a stream over what is there."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def sequenced(quotes: DataFrame) -> DataFrame:
    """A stream of accepted quotes (instrument, price, received_at) with a number per instrument that rises by one with each, by time of receipt within a batch.

    State is one number per instrument, kept over restarts.
    """

    def number(key, frames, state):
        last = state.get[0] if state.exists else 0
        frame = pd.concat(list(frames)).sort_values("received_at", kind="stable")
        frame["sequence"] = range(last + 1, last + 1 + len(frame))
        state.update((last + len(frame),))
        yield frame[["instrument", "price", "received_at", "sequence"]]

    kind = quotes.schema["instrument"].dataType.simpleString()
    schema = f"instrument {kind}, price double, received_at timestamp, sequence long"
    return quotes.select("instrument", "price", "received_at").groupBy("instrument").applyInPandasWithState(number, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def latest(quotes: DataFrame, order: str, *values: str) -> DataFrame:
    """The last quote of each instrument so far; for sinks in update or complete mode."""
    return quotes.groupBy("instrument").agg(F.max_by(F.struct(order, *values), order).alias("q")).select("instrument", "q.*")


def session_closes(quotes: DataFrame, late: str = "5 minutes", session: str = "1 day") -> DataFrame:
    """The last price of each instrument and session, given out once quotes later than `late` can no longer change it."""
    timed = quotes.withWatermark("received_at", late)
    closes = timed.groupBy("instrument", F.window("received_at", session)).agg(F.max_by("price", "received_at").alias("price"), F.count(F.lit(1)).alias("n_quotes"))
    return closes.select("instrument", F.col("window.start").alias("session_start"), "price", "n_quotes")


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, a temporary one only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="stream-")


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The rows an append-mode stream gives for all that its source holds now."""
    home = folder(spark)
    stream.writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def settled(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """The last whole result of an aggregating stream over all that its source holds now."""
    home, done = folder(spark), []

    def write(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{home}/rows-{batch}")
        done.append(f"{home}/rows-{batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(done[-1]) if done else spark.createDataFrame([], stream.schema)
