"""Registered queries over chains, timelines, canonical values and stored results, with the SQL that checks them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import canonical
from tidemark.operators import catalogue, chains, timeline
from tidemark.workers import kept

MARKET, KNOWN = datetime.datetime(1998, 6, 1), datetime.datetime(1998, 9, 1)
CUTOFF = chains.Cutoff(MARKET, KNOWN, "standard", 2)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))


# The same expressions in both dialects: quotes of orders, two versions and mappings of each contract, and assessments.
_CONTRACT = "o_orderkey % 500"
_VERSION = "case when o_orderkey % 97 = 0 then -1 when o_orderkey % 3 = 0 then o_orderkey % 500 * 10 + 2 else o_orderkey % 500 * 10 + 1 end"
_MAPPING = f"case when o_orderkey % 89 = 0 then 10 else ({_VERSION}) * 10 + 1 end"
_TARGET = """case when o_orderkey % 1009 = 0 then o_orderkey + 500 when (o_orderkey - 500) % 1009 = 0 then o_orderkey - 500 when o_orderkey % 143 = 0 then o_orderkey when o_orderkey % 169 = 0 then o_orderkey + 1000000000
when o_orderkey % 121 = 0 then o_orderkey - 1 when o_orderkey % 11 = 0 then o_orderkey - 500 when o_orderkey % 13 = 0 then o_orderkey - 1000 end"""
_BASIS = "case o_orderkey % 5 when 0 then 'historical_import' when 1 then 'provider_disseminated' else 'received' end"
_TYPE = "case when o_orderkey % 151 = 0 then 'futures_quote_observation' else 'option_quote_observation' end"


def quote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    available = F.col("o_orderdate") + F.when(key % 2 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval 60 days"))
    rows = _orders(spark, sf_dir).select(
        key.alias("event_id"), *(F.expr(sql).alias(n) for n, sql in (("contract_id", _CONTRACT), ("event_type", _TYPE), ("version_id", _VERSION), ("mapping_id", _MAPPING), ("availability_basis", _BASIS), ("supersedes_event_id", _TARGET))),
        F.col("o_orderdate").alias("exchange_timestamp"), F.when(key % 5 > 1, available).alias("received_at"), available.alias("available_at"),
        F.when(key % 3 == 0, key % 100).alias("provider_sequence"), F.when(key % 7 == 0, key % 9).alias("event_order"), F.col("o_totalprice").alias("bid"),
    )
    return rows.unionByName(rows.filter("event_id % 10 = 3")).unionByName(rows.filter("event_id % 983 = 5").withColumn("bid", F.lit(-1.0)))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _orders(spark, sf_dir).select(F.expr(_CONTRACT).alias("c")).distinct().withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    day = lambda sql: F.expr(f"timestamp '{sql}'")
    return c.select(
        (F.col("c") * 10 + F.col("v")).alias("version_id"), F.when((F.col("c") % 41 == 0) & (F.col("v") == 2), F.col("c") + 1).otherwise(F.col("c")).alias("contract_id"),
        day("1992-01-01").alias("valid_from"), F.when((F.col("c") % 7 == 0) & (F.col("v") == 1), day("1996-03-01")).alias("valid_until"), F.when(F.col("c") % 13 == 0, day("1999-01-01")).otherwise(day("1990-01-01")).alias("recorded_at"),
        F.when(F.col("c") % 17 == 0, day("1998-08-01")).alias("superseded_at"),
    )


def _mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = F.col("version_id"), F.floor(F.col("version_id") / 10)
    day = lambda sql: F.expr(f"timestamp '{sql}'")
    return _versions(spark, sf_dir).filter(v % 470 != 1).select(
        (v * 10 + 1).alias("mapping_id"), v, F.when(c % 19 == 0, day("1995-06-01")).otherwise(day("1991-01-01")).alias("valid_from"), F.when(c % 23 == 0, day("1998-05-01")).alias("valid_until"), day("1990-01-01").alias("recorded_at"), F.lit(None).cast("timestamp").alias("superseded_at"),
    )


def _assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    orders = _orders(spark, sf_dir).filter(key % 19 != 0)
    first = orders.select(key.alias("event_id"), (key * 2).alias("assessment_id"), F.lit("standard").alias("policy_id"), F.when(key % 31 == 0, 1).otherwise(2).alias("policy_version"), (at + F.expr("interval 2 days")).alias("recorded_at"), F.when(key % 23 == 0, "quarantined").when(key % 4 == 0, "accepted_with_flags").otherwise("accepted").alias("disposition"))
    later = orders.filter(key % 29 == 0).select(key.alias("event_id"), (key * 2 + 1).alias("assessment_id"), F.lit("standard").alias("policy_id"), F.lit(2).alias("policy_version"), (at + F.expr("interval 90 days")).alias("recorded_at"), F.lit("rejected").alias("disposition"))
    return first.unionByName(later)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.eligibility(quote_rows(spark, sf_dir), _versions(spark, sf_dir), _mappings(spark, sf_dir), _assessments(spark, sf_dir), CUTOFF)


def quote_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("event_id", "contract_id", "reason", "eligible")


def correction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.correction_faults(_judged(spark, sf_dir))


def option_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = kept(_judged(spark, sf_dir))
    return chains.chain(judged, chains.correction_faults(judged), "bid")


def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested value for each order, as canonical JSON and its digest."""
    key = F.col("o_orderkey")
    value = F.struct(
        key.alias("key"), F.col("o_totalprice").alias("price"), (key % 7 * 1e20).alias("large"), (key % 3 * 1e-7).alias("small"), (key % 2 == 0).alias("even"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderdate") + F.make_dt_interval(secs=key % 60 + 0.25)).alias("at"),
        F.create_map(F.col("o_orderstatus"), key % 10, F.lit('a "b"\n'), F.lit(None).cast("long")).alias("counts"), F.array(F.col("o_orderpriority"), F.lit("x")).alias("tags"), F.when(key % 5 > 0, F.struct((key % 5).alias("n"))).alias("inner"),
    )
    rows = _orders(spark, sf_dir).select("o_orderkey", value.alias("v"))
    rows = rows.select("o_orderkey", canonical.payload(rows, "v", {"tags"}).alias("json"))
    return rows.select("o_orderkey", "json", canonical.digest(F.col("json")).alias("digest"))


def record_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Underlying, option, version and mapping ids of the parts, each resting on the one before."""
    part, lit = F.col("p_partkey"), F.lit
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size", canonical.underlying_id(lit("XNSE"), F.col("p_brand"), lit("index"), lit("INR")).alias("underlying_id"))
    start = F.expr("timestamp '2024-01-01' + make_dt_interval(cast(p_partkey % 300 as int))")
    rows = rows.withColumn("option_id", canonical.option_id(lit("XNSE"), F.col("underlying_id"), F.to_date(start), part + 0.5, F.when(part % 2 == 0, "call").otherwise("put"), lit("european"), lit("cash"), lit(50), lit("INR")))
    rows = rows.withColumn("version_id", canonical.version_id("option_contract_version", F.col("option_id"), start, F.when(part % 3 == 0, start + F.expr("interval 30 days")), F.col("p_size"), lit("0.05"), F.concat(lit("S"), part.cast("string")), lit("active"), lit("cat-1")))
    mapping = canonical.mapping_id(lit("p"), F.concat(lit("SEG|"), part.cast("string")), F.col("version_id"), lit("sha256:0"), F.when(part % 4 == 0, part.cast("string")), start, lit(None).cast("timestamp"))
    return rows.select("p_partkey", "underlying_id", "option_id", "version_id", mapping.alias("mapping_id"))


def version_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as records of one scope, of which every fifth key begins a chain; some break it."""
    key, at = F.col("o_orderkey"), F.col("o_orderdate")
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", at.cast("timestamp").alias("o_orderdate")).withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("o_orderkey").over(order))
    start = at + F.make_dt_interval(((key % 7 - 3) * 30).cast("int"))
    target = F.when(key % 5 == 0, None).when((key % 241 == 0) & (F.col("o_custkey") % 2 == 0), key + 10**9).otherwise(F.col("before"))
    return rows.select(
        key.alias("record_id"), F.col("o_custkey").alias("scope_id"), target.alias("supersedes_record_id"), (at + F.make_dt_interval(secs=F.col("place").cast("decimal(18,6)"))).alias("recorded_at"),
        start.alias("valid_from"), F.when(key % 4 > 0, start + F.make_dt_interval(((key % 13 + 1) * 60).cast("int"))).alias("valid_until"), "before",
    )


def _cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    known = F.when(key % 17 > 0, at + F.make_dt_interval((key % 900).cast("int")))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("cutoff_id"), F.col("o_custkey").alias("scope_id"), (at + F.make_dt_interval(F.lit(100))).alias("market_as_of"), known.alias("known_as_of"))


def version_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.states(version_records(spark, sf_dir), _cutoffs(spark, sf_dir))


def provider_key_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings recorded an hour after their versions; every second one points at the version before."""
    versions = version_records(spark, sf_dir)
    key = F.col("record_id")
    mappings = versions.select(
        key, "scope_id", F.when(key % 3 > 0, F.col("before")).alias("supersedes_record_id"), (F.col("recorded_at") + F.expr("interval 1 hour")).alias("recorded_at"), (F.col("valid_from") - F.expr("interval 90 days")).alias("valid_from"), F.when(key % 6 > 0, F.col("valid_until")).alias("valid_until"),
        F.when(key % 2 == 0, F.coalesce("before", key)).otherwise(key).alias("version_id"),
    )
    return timeline.mapping_states(mappings, versions.drop("before"), _cutoffs(spark, sf_dir))


PROFILE = catalogue.Profile("p", "p-index-1", "IDX|N", "N_50", "XNSE", "INR", "INDEX", "FO", ("N", "N 50"))
# One provider row of each part, the same text in both dialects; %s joins texts.
_ROW = """case when p_partkey < 20 and p_partkey <> 3 or p_partkey = 25 then '{"exchange":"XNSE","instrument_key":"IDX|N","instrument_type":"INDEX","lot_size":' || case when p_partkey = 25 then 2 else 1 end || ',"segment":"INDEX","tick_size":5,"trading_symbol":"N"}'
else '{"exchange":"XNSE","expiry":' || case when p_partkey = 49 then '"soon"' else cast(1704067200000 + p_partkey % 50 * 86400000 as varchar(20)) end || ',"instrument_key":"FO|' || case when p_partkey = 47 then 27 else p_partkey end || '","instrument_type":"' ||
case p_partkey % 3 when 0 then 'FUT' when 1 then 'CE' else 'PE' end || '","lot_size":50,' || case when p_partkey = 51 then '"note":null,' else '' end || '"segment":"FO","strike_price":' || p_partkey || '.5,"tick_size":2.5,"trading_symbol":"S' || p_partkey ||
'","underlying_key":"' || case when p_partkey % 7 = 0 then 'IDX|X' else 'IDX|N' end || '","underlying_symbol":"n_50","underlying_type":"INDEX"}' end"""


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty artifacts of the parts' rows; every eleventh row stands twice."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(_ROW).alias("row")).withColumn("copy", F.explode(F.expr("if(p_partkey % 11 = 0, array(1, 2), array(1))")))
    number = F.row_number().over(W.partitionBy(F.col("p_partkey") % 20).orderBy("p_partkey", "copy")).cast("long")
    rows = parts.select(F.concat(F.lit("art-"), (F.col("p_partkey") % 20).cast("string")).alias("artifact_id"), number.alias("row_number"), "row", F.sha2("row", 256).alias("row_hash"))
    return catalogue.outcomes(rows, PROFILE)


def catalogue_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _catalogue(spark, sf_dir)
    return out.select("artifact_id", "row_number", "provider_key", "disposition", "reason", "kind", "expiry", F.col("strike").cast("double").alias("strike"), "option_side", "lot_size", F.col("tick_size").cast("double").alias("tick_size"), "normalized_hash", "semantic_id", "occurrence_id")


def catalogue_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.plans(_catalogue(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (quote_eligibility, correction_audit, option_chain, canonical_values, record_identities, version_states, provider_key_states, catalogue_outcomes, catalogue_plans)
}

_C = f"""o as (select *, {_CONTRACT} as contract_id, {_VERSION} as version_id, {_MAPPING} as mapping_id, {_TARGET} as target, {_BASIS} as basis, {_TYPE} as event_type,
o_orderdate + case when o_orderkey % 2 = 0 then interval 1 day else interval 60 day end as available, o_orderkey % 983 = 5 as twice from orders),
v as (select c * 10 + v as version_id, case when c % 41 = 0 and v = 2 then c + 1 else c end as contract_id, timestamp '1992-01-01' as f, case when c % 7 = 0 and v = 1 then timestamp '1996-03-01' end as u,
case when c % 13 = 0 then timestamp '1999-01-01' else timestamp '1990-01-01' end as r, case when c % 17 = 0 then timestamp '1998-08-01' end as s from (select distinct {_CONTRACT} as c from orders), (select unnest([1, 2]) as v)),
m as (select version_id * 10 + 1 as mapping_id, version_id, case when version_id // 10 % 19 = 0 then timestamp '1995-06-01' else timestamp '1991-01-01' end as f, case when version_id // 10 % 23 = 0 then timestamp '1998-05-01' end as u from v where version_id % 470 <> 1),
a as (select o_orderkey as event_id, o_orderkey * 2 as id, case when o_orderkey % 31 = 0 then 1 else 2 end as pv, o_orderdate + interval 2 day as r, case when o_orderkey % 23 = 0 then 'quarantined' else 'accepted' end as d from orders where o_orderkey % 19 <> 0
union all select o_orderkey, o_orderkey * 2 + 1, 2, o_orderdate + interval 90 day, 'rejected' from orders where o_orderkey % 19 <> 0 and o_orderkey % 29 = 0),
l as (select event_id, max_by(d, (r, id)) as d from a where pv = 2 and r <= timestamp '{KNOWN}' group by 1),
j as (select o.*, case when twice then 'conflicting_identity' when v.version_id is null then 'missing_version' when m.mapping_id is null then 'missing_mapping' when v.contract_id <> o.contract_id then 'version_of_other_contract'
when m.version_id <> o.version_id then 'mapping_of_other_version' end as refers,
case when not (v.f <= timestamp '{MARKET}' and (v.u is null or timestamp '{MARKET}' < v.u) and v.r <= timestamp '{KNOWN}' and (v.s is null or timestamp '{KNOWN}' < v.s)) then 'stale_version'
when not (m.f <= timestamp '{MARKET}' and (m.u is null or timestamp '{MARKET}' < m.u)) then 'stale_mapping' end as stale,
case when o_orderdate > timestamp '{MARKET}' then 'after_market_cutoff' when available > timestamp '{KNOWN}' then 'after_knowledge_cutoff' when basis = 'historical_import' then 'indefensible_availability' end as late,
case when l.d is null then 'not_assessed' when l.d <> 'accepted' then 'not_admitted' end as judged,
coalesce(v.f <= o_orderdate and (v.u is null or o_orderdate < v.u) and v.r <= available and (v.s is null or available < v.s) and m.f <= o_orderdate and (m.u is null or o_orderdate < m.u), false) as own
from o left join v using (version_id) left join m using (mapping_id) left join l on l.event_id = o.o_orderkey),
e as (select o_orderkey as event_id, *, coalesce(refers, stale, late, judged) as reason, refers is null and late is null and own as eligible from j)"""
_G = f"""{_C}, k as (select s.event_id, s.contract_id, s.target, case when s.target = s.event_id then 'self' when not coalesce(t.eligible, false) then 'no_eligible_target' when t.contract_id <> s.contract_id then 'other_contract' when t.event_type <> s.event_type then 'other_type' end as fault
from e s left join e t on t.event_id = s.target where s.reason is null and s.target is not null),
b as (select target from k where fault is null group by 1 having count(*) > 1), w as (select * from k where fault is null and target not in (select target from b)),
r as (select event_id as origin, target as reached, 1 as n from w union all select r.origin, w.target, n + 1 from r join w on w.event_id = r.reached where r.reached <> r.origin and n < 100),
x as (select event_id, contract_id, fault from k where fault is not null union all select event_id, contract_id, 'branch' from k where fault is null and target in (select target from b)
union all select event_id, contract_id, 'cycle' from w where event_id in (select origin from r where reached = origin))"""
_T = """o as (select o_orderkey as id, o_custkey as scope, o_orderdate as day, row_number() over w as place, lag(o_orderkey) over w as before from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
v as (select id, scope, before, case when id % 5 = 0 then null when id % 241 = 0 and scope % 2 = 0 then id + 1000000000 else before end as target, day + to_seconds(place) as r, day + to_days(((id % 7 - 3) * 30)::int) as f,
case when id % 4 > 0 then day + to_days(((id % 7 - 3) * 30)::int) + to_days(((id % 13 + 1) * 60)::int) end as u from o),
c as (select id as cutoff, scope, day + interval 100 day as market, case when id % 17 > 0 then day + to_days((id % 900)::int) else timestamp '9999-12-31' end as known from o),
t as (select id, id as root from v where target is null union all select v.id, coalesce(t.root, v.id) from v join t on v.target = t.id),
x as (select id, root from t union all select id, target from v where target > 999999999),
b as (select scope, min(r) as since from v where target > 999999999 group by 1),
h as (select cutoff, root, max_by(id, r) as id from c join v using (scope) join (select id, root from t) using (id) where r <= known and f <= market and (u is null or market < u) group by 1, 2),
k as (select cutoff, count(*) as n, min(id) as id from h group by 1),
s as (select cutoff, scope, known, market, case when since <= known then 'corrupt' when n is null then 'none' when n > 1 then 'ambiguous' else 'resolved' end as state, k.id from c left join k using (cutoff) left join b using (scope))"""
_U = "sha256:' || sha256('{\"canonical_symbol\":\"N_50\",\"currency\":\"INR\",\"entity\":\"underlying_instrument\",\"exchange\":\"XNSE\",\"instrument_type\":\"index\"}') || '"
_P = f"""g as (select p_partkey as k, 'art-' || p_partkey % 20 as artifact_id, row_number() over (partition by p_partkey % 20 order by p_partkey, c) as row_number, c, {_ROW} as row from part, (select unnest([1, 2]) as c) where c = 1 or p_partkey % 11 = 0),
i as (select *, sha256(row) as row_hash, (k < 20 and k <> 3) or k = 25 as own, 'FO|' || case when k = 47 then 27 else k end as fo, date '2024-01-01' + (k % 50)::int as expiry from g),
d as (select *, case when own then 'IDX|N' else fo end as provider_key, case when not own and k % 7 = 0 then 'excluded_by_profile' when c = 2 then 'exact_duplicate' when k = 49 then 'expiry' when k in (27, 47, 5, 25) then 'conflicting_provider_key' end as reason from i),
z as (select *, case when reason is null then 'accepted' when reason like 'ex%e' and reason <> 'expiry' then reason else 'refused' end as disposition from d),
y as (select *, case when disposition = 'accepted' then case when own then '{{"canonical_symbol":"N_50","currency":"INR","display_symbol":"N","exchange":"XNSE","instrument_type":"index","kind":"underlying","lot_size":"1","provider_contract_key":"IDX|N","tick_size":"0.05","trading_status":"active"}}'
else '{{"currency":"INR","display_symbol":"S' || k || '","exchange":"XNSE",' || case when k % 3 > 0 then '"exercise_style":"european",' else '' end || '"expiry":"' || expiry || '","kind":"' || case when k % 3 = 0 then 'future' else 'option' end || '","lot_size":"50","multiplier":"1",' ||
case k % 3 when 0 then '' when 1 then '"option_side":"call",' else '"option_side":"put",' end || '"provider_contract_key":"' || fo || '","settlement_type":"cash",' || case when k % 3 > 0 then '"strike":"' || k || '.5",' else '' end || '"tick_size":"0.025","trading_status":"active","underlying_instrument_id":"{_U}"}}' end end as projection from z)"""
_N = "rtrim(rtrim(o_totalprice::varchar, '0'), '.')"
ORACLE_SQL = {
    "quote_eligibility": f"with {_C} select event_id, contract_id, reason, eligible from e",
    "correction_audit": f"with recursive {_G} select * from x",
    "option_chain": f"""with recursive {_G}, h as (select * from e where reason is null and event_id not in (select target from e where reason is null and target is not null)),
q as (select contract_id, max_by(event_id, (o_orderdate, case when event_id % 3 = 0 then event_id % 100 else -1 end, case when event_id % 7 = 0 then event_id % 9 else -1 end, available, available, event_id)) as event_id from h group by 1),
f as (select contract_id, min(fault) as fault from x group by 1)
select contract_id, fault, case when fault is null then q.event_id end as event_id, case when fault is null then o_orderdate end as exchange_timestamp, case when fault is null then o_totalprice end as bid from q full join f using (contract_id) left join orders on o_orderkey = q.event_id""",
    "canonical_values": f"""with j as (select o_orderkey, '{{"at":"' || strftime(o_orderdate + to_microseconds(o_orderkey % 60 * 1000000 + 250000), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","counts":' ||
case when o_orderstatus < 'a' then '{{"' || o_orderstatus || '":"' || o_orderkey % 10 || '","a \\"b\\"\\n":null}}' end || ',"day":"' || o_orderdate::date || '","even":' || (o_orderkey % 2 = 0) || ',"inner":' || case when o_orderkey % 5 > 0 then '{{"n":"' || o_orderkey % 5 || '"}}' else 'null' end ||
',"key":"' || o_orderkey || '","large":"' || case when o_orderkey % 7 = 0 then '0' else o_orderkey % 7 || repeat('0', 20) end || '","price":"' || {_N} || '","small":"' || case o_orderkey % 3 when 0 then '0' when 1 then '0.0000001' else '0.0000002' end || '","tags":["' || o_orderpriority || '","x"]}}' as json from orders)
select o_orderkey, json, 'sha256:' || sha256(json) as digest from j""",
    "record_identities": """with u as (select *, timestamp '2024-01-01' + to_days((p_partkey % 300)::int) as f, 'sha256:' || sha256('{"canonical_symbol":"' || p_brand || '","currency":"INR","entity":"underlying_instrument","exchange":"XNSE","instrument_type":"index"}') as underlying_id from part),
o as (select *, 'sha256:' || sha256('{"currency":"INR","entity":"option_contract","exchange":"XNSE","exercise_style":"european","expiry":"' || f::date || '","multiplier":"50","option_side":"' || case when p_partkey % 2 = 0 then 'call' else 'put' end || '","settlement_type":"cash","strike":"' || p_partkey || '.5","underlying_instrument_id":"' || underlying_id || '"}') as option_id from u),
v as (select *, 'sha256:' || sha256('{"catalogue_version_id":"cat-1","display_symbol":"S' || p_partkey || '","entity":"option_contract_version","identity_id":"' || option_id || '","lot_size":"' || p_size || '","tick_size":"0.05","trading_status":"active","valid_from":"' || f::date || 'T00:00:00+00:00","valid_until":' ||
case when p_partkey % 3 = 0 then '"' || (f + interval 30 day)::date || 'T00:00:00+00:00"' else 'null' end || '}') as version_id from o)
select p_partkey, underlying_id, option_id, version_id, 'sha256:' || sha256('{"contract_version_id":"' || version_id || '","effective_from":"' || f::date || 'T00:00:00+00:00","effective_until":null,"entity":"provider_contract_mapping","provider":"p","provider_contract_key":"SEG|' || p_partkey || '","provider_payload_hash":"sha256:0","source_row_identity":' ||
case when p_partkey % 4 = 0 then '"' || p_partkey || '"' else 'null' end || '}') as mapping_id from v""",
    "version_states": f"with recursive {_T} select cutoff as cutoff_id, scope as scope_id, case when state = 'resolved' then id end as record_id, state from s",
    "provider_key_states": f"""with recursive {_T}, m as (select id, scope, case when id % 3 > 0 then before end as target, r + interval 1 hour as r, f - interval 90 day as f, case when id % 6 > 0 then u end as u, case when id % 2 = 0 then coalesce(before, id) else id end as version from v),
g as (select id, id as root from m where target is null union all select m.id, g.root from m join g on m.target = g.id),
y as (select cutoff, root, m.id, version, m.r, state, m.f <= market and (m.u is null or market < m.u) and state = 'resolved' and version = s.id as good from s join m using (scope) join g on g.id = m.id where m.r <= known),
z as (select cutoff, root, max_by(id, r) filter (where good) as id, max_by(version, r) filter (where good) as version, bool_or(state = 'corrupt') as c, bool_or(state = 'ambiguous') as a from y group by 1, 2),
w as (select cutoff, count(id) as n, min(id) as id, min(version) as version, bool_or(c) as c, bool_or(a) as a from z group by 1),
q as (select s.cutoff, s.scope, case when c then 'corrupt_version' when a then 'ambiguous_version' when coalesce(n, 0) = 0 then 'none' when n > 1 then 'ambiguous' else 'resolved' end as state, w.id, version from s left join w using (cutoff))
select cutoff as cutoff_id, scope as scope_id, case when state = 'resolved' then id end as record_id, case when state = 'resolved' then version end as version_id, case when state = 'resolved' then scope end as instrument_id, state from q""",
    "catalogue_outcomes": f"""with {_P} select artifact_id, row_number, provider_key, disposition, reason, case when projection is null then null when own then 'underlying' when k % 3 = 0 then 'future' else 'option' end as kind, case when projection is not null and not own then expiry end as expiry,
case when projection is not null and not own and k % 3 > 0 then k + 0.5::double end as strike, case when projection is not null and not own then case k % 3 when 1 then 'call' when 2 then 'put' end end as option_side, case when projection is not null then case when own then 1 else 50 end end as lot_size,
case when projection is not null then case when own then 0.05::double else 0.025::double end end as tick_size, 'sha256:' || sha256(projection) as normalized_hash,
'sha256:' || sha256('{{"entity":"catalogue_source_row_semantic","profile_version":"p-index-1","provider":"p","raw_row_hash":"' || row_hash || '"}}') as semantic_id,
'sha256:' || sha256('{{"entity":"catalogue_source_row_occurrence","physical_row_number":"' || row_number || '","raw_row_hash":"' || row_hash || '","source_artifact_id":"' || artifact_id || '"}}') as occurrence_id from y""",
    "catalogue_plans": f"""with {_P}, x as (select artifact_id, count(*) as physical_rows, count(*) filter (where disposition = 'accepted') as accepted, count(*) filter (where disposition = 'exact_duplicate') as duplicates, count(*) filter (where disposition = 'excluded_by_profile') as excluded,
count(*) filter (where disposition = 'refused') as refused, count(distinct row_hash) filter (where own) as n, min_by(reason, row_number) filter (where disposition = 'refused') as why, string_agg(projection, ',' order by 'sha256:' || sha256(projection), projection) as items, bool_or(k = 51) as noted from y group by 1)
select artifact_id, physical_rows, accepted, duplicates, excluded, refused, case when n = 0 then 'missing_underlying' when n > 1 then 'duplicate_underlying' else why end as fault,
'sha256:' || sha256('{{"entity":"catalogue_field_fingerprint","fields":["exchange","expiry","instrument_key","instrument_type","lot_size",' || case when noted then '"note",' else '' end || '"segment","strike_price","tick_size","trading_symbol","underlying_key","underlying_symbol","underlying_type"]}}') as field_fingerprint,
case when n = 1 and why is null then 'sha256:' || sha256('{{"entity":"normalized_provider_catalogue","items":[' || items || ']}}') end as catalogue_hash from x""",
}
