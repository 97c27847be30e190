"""Daily closes from a provider's candle payloads, and the gate on their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closes(payloads: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """payloads (instrument_id, payload): the provider's object with data.candles, or the bare array, of [time with zone, open, high, low, close, ...], all as texts or numbers.

    Candles of fewer than five fields, without a zone, or whose close is not positive and finite are left out; each local day keeps its last.
    """
    rows = payloads.select("instrument_id", F.explode(F.coalesce(F.from_json("payload", "struct<data: struct<candles: array<array<string>>>>")["data"]["candles"], F.from_json("payload", "array<array<string>>"))).alias("c")).filter(F.size("c") >= 5)
    stamp, close = F.col("c")[0], F.expr("try_cast(c[4] as double)")
    rows = rows.filter(stamp.rlike(r"(Z|[+-]\d\d:?\d\d)$")).select("instrument_id", F.expr("try_cast(c[0] as timestamp)").alias("at"), close.alias("close"))
    rows = rows.filter(F.col("at").isNotNull() & (F.col("close") > 0) & (F.col("close") < float("inf")))
    local = F.to_date(F.expr(f"convert_timezone(current_timezone(), '{zone}', cast(at as timestamp_ntz))"))
    return rows.groupBy("instrument_id", local.alias("session_date")).agg(F.max_by("close", "at").alias("price"))


def enough(prices: DataFrame, least: int = 100) -> DataFrame:
    """The prices of instruments that have at least so many."""
    many = prices.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return prices.join(many, "instrument_id", "left_semi")
