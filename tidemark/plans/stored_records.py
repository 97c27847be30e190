"""Registered queries over stored records, instruments and datasets, with the SQL that checks them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import digests
from tidemark.operators import lifecycle, stored
from tidemark.sources.prices import daily_closes

KNOWN = datetime.datetime(1997, 6, 1)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as mappings of one key (the first part of the lines' greatest order), orders as their records, parts as versions."""
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    mappings = lines.groupBy(F.col("l_orderkey").alias("mapping_id")).agg(F.min("l_partkey").alias("version_id"), (F.max("l_suppkey") % 7).alias("provider_key"))
    records = orders.select(F.col("o_orderkey").alias("mapping_id"), (F.col("o_orderkey") * 2).alias("record_id"), F.col("o_orderdate").cast("timestamp").alias("recorded_at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") - 1).alias("supersedes_record_id"))
    versions = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version_id"), F.col("p_brand").alias("instrument_id"))
    out = stored.mapped(mappings, records, versions, 3, KNOWN)
    return out.select("mapping_id", "version_id", "record_id", "supersedes_record_id", "instrument_id")


def identified_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registered instruments of three kinds, of which some have lost their own row."""
    key, kind = F.col("c_custkey"), F.element_at(F.array(*map(F.lit, ("underlying", "future", "option"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = _table(spark, sf_dir, "customer")
    registry = rows.select(key.alias("instrument_id"), kind.alias("kind"))
    of = lambda i, *more: rows.filter((key % 3 == i) & (key % 10 != 7)).select(key.alias("instrument_id"), *more)
    out = stored.identified(registry, underlying=of(0, F.col("c_mktsegment").alias("symbol")), future=of(1, F.col("c_nationkey").alias("expiry")), option=of(2, F.col("c_nationkey").alias("expiry"), F.col("c_acctbal").alias("strike")))
    return out.select("instrument_id", "kind", "lost", F.col("underlying.symbol").alias("symbol"), F.coalesce("future.expiry", "option.expiry").alias("expiry_code"), F.col("option.strike").alias("strike"))


def subject_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty events of the user of the greatest event that purchases of the same properties hold."""
    events = _table(spark, sf_dir, "events")
    held = events.filter("event_type in ('purchase', 'click')").select("event_id")
    last = events.agg(F.max_by("user_id", "event_id").alias("subject"))
    rows = events.join(F.broadcast(last), events["user_id"] == last["subject"]).withColumnRenamed("subject", "subject_id")  # one row
    return stored.observations(rows, held, F.col("user_id"), 40, "ts", "event_id").select("event_id", "event_type", "value")


def provider_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest hundred states of one provider that results of the second version hold."""
    key = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select(key, (key % 2 + 1).cast("int").alias("schema_version"), F.when(key % 3 == 0, "p").otherwise("q").alias("provider"), F.col("ts").cast("timestamp").alias("provider_at"), "value")
    members = rows.filter((key % 5 != 0) & (F.col("schema_version") == 2)).select("event_id", "schema_version")
    return stored.states(rows, members, "p", 100).select("event_id", "value")


def resolution_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as batches of resolved or failed keys, a few of them in wrong order, double, or both."""
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    rows = _table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    name = F.when((key % 23 == 0) & (number == 2), 9).when((key % 29 == 0) & (number == 3), 1).otherwise(number)
    rows = rows.select(key.alias("batch"), number.alias("place"), F.concat(F.lit("k"), name.cast("string")).alias("provider_key"), F.when((key + number) % 4 > 0, "s").alias("subject_id"), F.when(((key + number) % 4 == 0) & (key % 31 != 0), "unknown").alias("failure"))
    return stored.resolution_faults(rows).select("batch", "place", "fault")


def provider_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments of parts, written with either spelling; those without a name or of other segments are none."""
    key = F.col("p_partkey")
    segment = F.when(key % 4 == 0, "XN_INDEX").when(key % 4 == 1, "XN_EQ").when(key % 4 == 2, "XB_EQ").otherwise("XX_FO")
    first = F.to_json(F.named_struct(F.lit("instrument_key"), F.concat(segment, F.lit("|"), (key % 1500).cast("string")), F.lit("segment"), segment, F.lit("name"), F.when(key % 9 > 0, F.col("p_name")).otherwise(" "), F.lit("trading_symbol"), F.concat(F.lit("T"), key.cast("string")), F.lit("tick_size"), F.col("p_size") - 3, F.lit("lot_size"), key % 3))
    second = F.to_json(F.named_struct(F.lit("instrumentKey"), F.concat(segment, F.lit("|"), (key % 1500).cast("string")), F.lit("tradingSymbol"), F.when(key % 7 > 0, F.concat(F.lit(" T"), key.cast("string"))), F.lit("lotSize"), F.lit("2.5")))
    rows = _table(spark, sf_dir, "part").select(key, F.when(key % 2 == 0, first).when(key % 11 == 0, F.lit("{")).otherwise(second).alias("row"))
    found = stored.instruments(rows, "row", ("XN_INDEX", "XN_EQ", "XB_EQ"))
    return stored.search(found, "p_partkey", ("XN",), ("index", "equity"), 700).select("p_partkey", "instrument_key", "exchange", "kind", "name", "trading_symbol", "tick_size", "lot_size")


def dataset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.dataset_ids(daily_closes(spark, sf_dir), "csv")


def lifecycle_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as sevens of connection states; some follow the wrong state, some failures lack their reason, some others have one."""
    e, names = F.col("event_id"), ("connecting", "connected", "authorized", "failed", "reconnecting", "closing", "closed")
    place = (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1) % 7
    rows = _table(spark, sf_dir, "events").withColumn("n", place)
    name = lambda at: F.get(F.array(*map(F.lit, names)), at)
    state = name(F.col("n"))
    reason = F.when((state == "failed") & (e % 3 != 0), "timeout").when((state != "failed") & (e % 17 == 0), "odd")
    raw = rows.select(e, e.cast("string").alias("raw_event_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("session_id"), F.when(e % 13 == 0, "closed").otherwise(F.when(F.col("n") > 0, name(F.col("n") - 1))).alias("previous_state"), state.alias("state"), reason.alias("reason_code"))
    return lifecycle.observed(raw.drop("event_id"), "connection", "session_id").select("raw_event_id", "fault", F.col("event_id").alias("observation_id"))


QUERIES = {f.__name__: f for f in (lifecycle_observations, stored_mappings, identified_instruments, subject_observations, provider_states, resolution_audit, provider_instruments, dataset_ids)}
_SEG = "case p_partkey % 4 when 0 then 'XN_INDEX' when 1 then 'XN_EQ' when 2 then 'XB_EQ' else 'XX_FO' end"
ORACLE_SQL = {
    "lifecycle_observations": """with n as (select *, (row_number() over (partition by user_id order by event_id) - 1) % 7 as n from events),
f as (select event_id::varchar as raw_event_id, user_id, case when event_id % 13 = 0 then 'transition' when n = 3 and event_id % 3 = 0 then 'reason_missing' when n <> 3 and event_id % 17 = 0 then 'reason_given' end as fault from n)
select raw_event_id, fault, case when fault is null then 'sha256:' || sha256('{"entity":"normalized_market_event","event_type":"provider_connection_lifecycle_observation","normalization_schema_version":"1","raw_event_id":"' || raw_event_id || '","subject_id":"c' || user_id || '"}') end as observation_id from f""",
    "stored_mappings": """with m as (select l_orderkey as mapping_id, min(l_partkey) as version_id, max(l_suppkey) % 7 as k from lineitem group by 1)
select mapping_id, version_id, o_orderkey * 2 as record_id, case when o_orderkey % 3 = 0 then o_orderkey - 1 end as supersedes_record_id, p_brand as instrument_id from m join orders on o_orderkey = mapping_id join part on p_partkey = version_id where k = 3 and o_orderdate <= timestamp '1997-06-01'""",
    "identified_instruments": """select c_custkey as instrument_id, ['underlying', 'future', 'option'][c_custkey % 3 + 1] as kind, c_custkey % 10 = 7 as lost, case when c_custkey % 3 = 0 and c_custkey % 10 <> 7 then c_mktsegment end as symbol,
case when c_custkey % 3 > 0 and c_custkey % 10 <> 7 then c_nationkey end as expiry_code, case when c_custkey % 3 = 2 and c_custkey % 10 <> 7 then c_acctbal end as strike from customer""",
    "subject_observations": """select event_id, event_type, value from events where user_id = (select max_by(user_id, event_id) from events) and event_type in ('purchase', 'click') order by ts, event_id limit 40""",
    "provider_states": "select event_id, value from events where event_id % 3 = 0 and event_id % 2 = 1 and event_id % 5 <> 0 order by ts desc, event_id desc limit 100",
    "resolution_audit": """with r as (select distinct l_orderkey as k, l_linenumber as n from lineitem), p as (select k, n, 'k' || case when k % 23 = 0 and n = 2 then 9 when k % 29 = 0 and n = 3 then 1 else n end as name, (k + n) % 4 > 0 as s, (k + n) % 4 = 0 and k % 31 <> 0 as f from r),
q as (select *, count(*) over (partition by k, name) as c, lag(name) over (partition by k order by n) as before from p)
select k as batch, n as place, case when c > 1 then 'repeated_key' when s = f then 'resolved_and_failed' else 'out_of_order' end as fault from q where c > 1 or s = f or name < before""",
    "provider_instruments": f"""with i as (select p_partkey, {_SEG} || '|' || p_partkey % 1500 as instrument_key, 'XN' as exchange, case when p_partkey % 4 = 0 then 'index' else 'equity' end as kind,
case when p_partkey % 2 = 0 then case when p_partkey % 9 > 0 then p_name else 'T' || p_partkey end else 'T' || p_partkey end as name, 'T' || p_partkey as trading_symbol, case when p_partkey % 2 = 0 and p_size > 3 then p_size - 3 end::double as tick_size, case when p_partkey % 2 = 0 and p_partkey % 3 > 0 then p_partkey % 3 else 1 end as lot_size
from part where p_partkey % 4 < 2 and (p_partkey % 2 = 0 or (p_partkey % 11 > 0 and p_partkey % 7 > 0)))
select * from i qualify row_number() over (partition by instrument_key order by p_partkey) = 1 order by p_partkey limit 700""",
    "dataset_ids": """with p as (select o_orderpriority as instrument_id, o_orderdate::date as d, max_by(o_totalprice, o_orderkey) as price from orders group by 1, 2)
select instrument_id, 'sha256:' || sha256('{"frequency":"1d_close","observations":[' || string_agg('{"price":"' || rtrim(rtrim(price::varchar, '0'), '.') || '","timestamp":"' || d || 'T00:00:00"}', ',' order by d) || '],"source":"csv","symbol":"' || instrument_id || '"}') as dataset_id from p group by 1""",
}
