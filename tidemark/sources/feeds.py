"""Live feed messages: quotes of requested instruments and states of market segments, for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import conversions

_LTPC = "struct<ltp: string, cp: string, ltq: string, ltt: string>"
_FULL = f"struct<marketFF: struct<ltpc: {_LTPC}>, market_ff: struct<ltpc: {_LTPC}>, indexFF: struct<ltpc: {_LTPC}>, index_ff: struct<ltpc: {_LTPC}>>"
_STATUS = "struct<segmentStatus: map<string,string>, segment_status: map<string,string>>"
_MESSAGE = f"struct<currentTs: string, current_ts: string, feeds: map<string, struct<ltpc: {_LTPC}, fullFeed: {_FULL}, full_feed: {_FULL}>>, marketInfo: {_STATUS}, market_info: {_STATUS}>"


def _positive(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when((number > 0) & (number < float("inf")), number)


def feed_quotes(messages: DataFrame, payload: str, received: str, requested: DataFrame | None = None, ahead_seconds: int = 300) -> DataFrame:
    """One row per instrument of a message with a positive price and a trade time that is not from the future.

    A malformed message or field gives no quote; prices and sizes that are no valid numbers are null. `requested` (instrument) limits the instruments.
    """
    m = messages.withColumn("_m", F.from_json(payload, _MESSAGE)).select("*", F.explode("_m.feeds").alias("instrument", "_f"))
    full = F.coalesce("_f.fullFeed", "_f.full_feed")
    ltpc = F.coalesce("_f.ltpc", *[full[k]["ltpc"] for k in ("marketFF", "market_ff", "indexFF", "index_ff")])
    time = lambda c: conversions.epoch_time(_positive(c))
    size = ltpc["ltq"].try_cast("long")
    out = m.select(
        *messages.columns, "instrument", _positive(ltpc["ltp"]).alias("price"), _positive(ltpc["cp"]).alias("previous_close"), F.when(size >= 0, size).alias("last_quantity"),
        time(ltpc["ltt"]).alias("traded_at"), F.coalesce(time(F.coalesce("_m.currentTs", "_m.current_ts")), F.col(received).cast("timestamp")).alias("provider_at"),
    )
    if requested is not None:
        out = out.join(requested.select("instrument"), "instrument", "left_semi")
    late = F.col(received).cast("timestamp") + F.expr(f"interval {ahead_seconds} seconds")
    return out.filter(F.col("price").isNotNull() & (F.col("traded_at") <= late))


def segment_states(messages: DataFrame, payload: str) -> DataFrame:
    """One row per market segment of a message: open, pre_open, closed or unknown."""
    m = messages.withColumn("_m", F.from_json(payload, _MESSAGE))
    state = F.coalesce(F.coalesce("_m.marketInfo", "_m.market_info")["segmentStatus"], F.coalesce("_m.marketInfo", "_m.market_info")["segment_status"])
    return m.select(*messages.columns, F.explode(state).alias("segment", "_s")).select(*messages.columns, "segment", conversions.market_status(F.col("_s")).alias("state"))
