"""Registered queries over provider payloads and event streams, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import audits, hedging
from tidemark.operators import events as ev
from tidemark.plans.market import _lines
from tidemark.sources import candles
from tidemark.sources.prices import daily_closes


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def candle_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles made from orders: one payload per order, with a zone for most, some too short or with a negative close."""
    key = F.col("o_orderkey")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T15:"), F.lpad((key % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(key / 60) % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((key % 1_000_000).cast("string"), 6, "0"), F.when(key % 7 == 0, "").otherwise("+05:30"))
    close = F.when(key % 11 == 0, -key).otherwise(key).cast("string")
    body = F.when(key % 13 == 0, F.concat(F.lit('[["'), stamp, F.lit('", 1, 2]]'))).otherwise(F.concat(F.lit('[["'), stamp, F.lit('", 1, 2, 3, '), close, F.lit(", 0]]")))
    body = F.when(key % 3 == 0, F.concat(F.lit('{"status": "success", "data": {"candles": '), body, F.lit("}}"))).otherwise(body)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderpriority is not null")
    return candles.closes(orders.select((key % 50).alias("instrument_id"), body.alias("payload")))


def history_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.enough(daily_closes(spark, sf_dir).filter("instrument_id <> '1-URGENT' or day(session_date) = 1"))


def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.ordered(_events(spark, sf_dir), "user_id", ["purchase", "click"], "event_type", "event_id").select("user_id", "event_id", "place")


def duplicate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.duplicates(_events(spark, sf_dir), ["user_id", "event_type", "props"], "event_id").select("event_id", "first_occurrence")


def observation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    given = lambda n, c: F.when(e % n == 0, c)
    return _events(spark, sf_dir).select("event_id", ev.observation_id(given(3, e), given(2, F.col("user_id")), e, given(5, F.col("event_type")), e, e).alias("observation_id"))


def remaining_maturity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.remaining(_lines(spark, sf_dir), "l_orderkey", "step", "l_tax", F.lit(0.1))
    return out.select("l_orderkey", "step", F.round("elapsed", 6).alias("elapsed"), F.round("remaining", 6).alias("remaining"))


def session_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    ranges = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", day.alias("first"), F.date_add(day, 9).alias("last"))
    return ev.sessions(ranges, "first", "last", ["1996-01-01"]).select("o_orderkey", "session", "session_date")


def daily_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hedging.daily_theta(_lines(spark, sf_dir), "l_orderkey", (F.col("l_quantity") - 30).cast("decimal(12,2)"))
    return out.select("l_orderkey", F.col("theta").cast("double").alias("theta"))


def failed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.failed_scopes(_events(spark, sf_dir).filter("value < 20"), "event_type", "user_id", "props")


QUERIES = {f.__name__: f for f in (candle_closes, history_gate, event_order, duplicate_split, observation_ids, remaining_maturity, session_calendar, daily_theta, failed_entries)}

_P = "p as (select o_orderpriority as instrument_id, cast(o_orderdate as date) as session_date, max_by(o_totalprice, o_orderkey) as price from orders group by 1, 2)"
_N = "n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as step from lineitem)"
ORACLE_SQL = {
    "candle_closes": """select o_orderkey % 50 as instrument_id, o_orderdate::date as session_date, max_by(o_orderkey, (o_orderkey % 60 * 60 + o_orderkey // 60 % 60) * 1000000 + o_orderkey % 1000000)::double as price from orders
where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 group by 1, 2""",
    "history_gate": f"""with {_P}, q as (select * from p where instrument_id <> '1-URGENT' or day(session_date) = 1)
select * from q where instrument_id in (select instrument_id from q group by 1 having count(*) >= 100)""",
    "event_order": "select user_id, event_id, row_number() over (partition by user_id order by case event_type when 'purchase' then 1 when 'click' then 2 else 3 end, event_id) as place from events",
    "duplicate_split": "select event_id, nullif(min(event_id) over (partition by user_id, event_type, props), event_id) as first_occurrence from events",
    "observation_ids": """select event_id, sha256(case when event_id % 3 = 0 then 'event|' || n when event_id % 2 = 0 then 'sequence|' || length(user_id::varchar) || ':' || user_id || '|' || n when event_id % 5 = 0 then 'row|' || length(event_type) || ':' || event_type || '|' || n else 'ingestion|' || n end) as observation_id from (select *, length(event_id::varchar) || ':' || event_id as n from events)""",
    "remaining_maturity": f"with {_N}, e as (select l_orderkey, step, sum(l_tax) over (partition by l_orderkey order by step) as elapsed from n) select l_orderkey, step, round(elapsed, 6) as elapsed, round(greatest(0.1::double - elapsed, 0), 6) as remaining from e",
    "session_calendar": """with d as (select o_orderkey, unnest(generate_series(o_orderdate::date, o_orderdate::date + 9, interval 1 day))::date as session_date from orders)
select o_orderkey, (row_number() over (partition by o_orderkey order by session_date) - 1)::int as session, session_date from d where isodow(session_date) < 6 and session_date <> date '1996-01-01'""",
    "daily_theta": "select l_orderkey, round_even(abs(sum(l_quantity - 30)) / 252, 2)::double as theta from lineitem group by 1",
    "failed_entries": "select event_type, count(distinct (user_id, props)) as n_scopes from events where value < 20 group by 1",
}
