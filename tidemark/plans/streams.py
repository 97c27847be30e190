"""Registered queries over live streams, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import registry
from tidemark.sources.prices import daily_closes
from tidemark.streaming import freshness, quotes, recompute


def stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes, of which some are of no price, some of the future and some the loss of a connection; quotes last six hours."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e, at = F.col("event_id"), F.col("ts").cast("timestamp")
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(
        F.col("user_id").alias("instrument"), F.when(e % 23 == 0, -1.0).otherwise(F.col("value") + 1).alias("price"), (at + F.make_dt_interval(mins=F.when(e % 29 == 0, 6).otherwise(5))).alias("traded_at"), at.alias("received_at"), F.when(e % 11 == 0, "down").alias("kind")
    )
    out = quotes.drained(spark, freshness.followed(events, seconds=6 * 3600))
    return out.select("instrument", "sequence", "price", F.unix_micros("received_at").alias("received_micros"), "freshness")


def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of all daily closes, fed in five batches, of which the third gives earlier sessions than the second."""
    home, closes = quotes.folder(spark), daily_closes(spark, sf_dir)
    source = f"{home}/source"
    month = F.year("session_date") * 12 + F.month("session_date")
    parts = [month % 5 != 4, (month % 5 == 4) & (F.year("session_date") % 3 == 0), (month % 5 == 4) & (F.year("session_date") % 3 == 1), (month % 5 == 4) & (F.year("session_date") % 3 == 2) & (F.dayofmonth("session_date") > 9)]
    rest = (month % 5 == 4) & (F.year("session_date") % 3 == 2) & (F.dayofmonth("session_date") <= 9)
    for part in [*parts, rest]:
        closes.filter(part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(closes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    recompute.follow(spark, home, stream).awaitTermination()
    return registry._rounded(recompute.current(spark, home, "features"))


QUERIES = {f.__name__: f for f in (stream_freshness, stream_features)}
ORACLE_SQL = {
    "stream_freshness": """with e as (select user_id as instrument, event_id, epoch_us(ts) as at_us, case when event_id % 11 = 0 then null else value + 1 end as price, event_id % 11 = 0 as down from events where event_id % 11 = 0 or (event_id % 23 <> 0 and event_id % 29 <> 0)),
q as (select *, lead(at_us) over w as next_us, coalesce(lead(down) over w, false) as next_down, sum(case when down then 0 else 1 end) over w as sequence from e window w as (partition by instrument order by at_us, price)),
m as (select max(epoch_us(ts)) // 1000 as last_ms from events where event_id % 11 = 0 or (event_id % 23 <> 0 and event_id % 29 <> 0))
select instrument, sequence::bigint as sequence, price, at_us as received_micros, 'fresh' as freshness from q where not down union all
select instrument, sequence::bigint, price, at_us, 'stale' from q, m where not down and (coalesce(next_us > at_us + 21600000000, false) or next_down or (next_us is null and (at_us + 21600000000) // 1000 < last_ms))""",
    "stream_features": registry.ORACLE_SQL["rv_features"],
}
