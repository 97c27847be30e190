"""Live quotes: the last of each instrument, how fresh it is, and changes against the close before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def accepted(quotes: DataFrame, ahead_seconds: int = 300) -> DataFrame:
    """Quotes (instrument, price, traded_at, received_at, ...) with a positive price that are not from the future."""
    late = F.col("received_at") + F.expr(f"interval {ahead_seconds} seconds")
    return quotes.filter((F.col("price") > 0) & (F.col("traded_at") <= late))


def latest(quotes: DataFrame, key: str, sequence: str, *values: str) -> DataFrame:
    """The quote of the highest sequence of each instrument."""
    return quotes.groupBy(key).agg(F.max_by(F.struct(sequence, *values), sequence).alias("q")).select(key, "q.*")


def freshness(latest_: DataFrame, instruments: DataFrame, key: str, received: str, now, seconds: int = 5) -> DataFrame:
    """awaiting, fresh or stale for every instrument asked for."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(received).cast("timestamp"))
    state = F.when(F.col(received).isNull(), "awaiting").when(age <= seconds * 1_000_000, "fresh").otherwise("stale")
    return instruments.join(latest_, key, "left").withColumn("freshness", state)


def rollup(states: DataFrame) -> DataFrame:
    """One row: the worst state that counts: unknown without instruments, stale before fresh before awaiting."""
    any_ = lambda s: F.coalesce(F.max((F.col("freshness") == s).cast("int")), F.lit(0)) == 1
    return states.agg(F.when(F.count(F.lit(1)) == 0, "unknown").when(any_("stale"), "stale").when(any_("fresh"), "fresh").otherwise("awaiting").alias("feed"))


def changes(prices: DataFrame) -> DataFrame:
    """Absolute and relative change against the previous close; null where it is missing or zero."""
    before = F.lag("price").over(W.partitionBy("instrument_id").orderBy("session_date"))
    base = F.when(before != 0, before)
    return prices.withColumn("change", F.col("price") - base).withColumn("relative_change", (F.col("price") - base) / base)


def page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows after a key, in order of the key."""
    return rows.filter(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def transport(events: DataFrame, stream: str, clock: str, state: str) -> DataFrame:
    """After each change of a connection: the attempts to reconnect since it was last connected, and whether its quotes are stale."""
    order = W.partitionBy(stream).orderBy(clock)
    since = F.sum((F.col(state) == "connected").cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    within = W.partitionBy(stream, "_since").orderBy(clock).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = events.withColumn("_since", since).withColumn("attempt", F.sum((F.col(state) == "reconnecting").cast("int")).over(within))
    return out.withColumn("stale", F.max(F.col(state).isin("reconnecting", "disconnected", "failed")).over(within)).drop("_since")


def counters(events: DataFrame, kind: str) -> DataFrame:
    """How often each kind occurred."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def own_change(quotes: DataFrame, price: str = "price", previous: str = "previous_close") -> DataFrame:
    """Each quote's change against the previous close that it carries itself; null where that is missing or not positive."""
    base = F.when(F.col(previous) > 0, F.col(previous))
    return quotes.withColumn("change", F.col(price) - base).withColumn("percent", (F.col(price) - base) / base * 100)
