"""Registered queries over run summaries, leg values, calendars, stored records, digests and memberships, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import options
from tidemark.operators import digests, events, hedging, quotes
from tidemark.plans import market, market_sql, wire_frames
from tidemark.plans import records as rec
from tidemark.sources.store import Store, successors
from tidemark.streaming.quotes import folder
from tidemark.workers import dealt

HOLIDAYS = ["1996-01-01", "1997-01-01", "1997-12-25"]


def leg_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of three calls or puts of fifty units, by one unit and against the market value in money."""
    legs = market._contracts(spark, sf_dir).withColumn("quantity", F.lit(3)).withColumn("multiplier", F.lit(50))
    out = options.leg_values(legs)
    unit = [F.round(F.col(f"position_{g}") / 150, 5).alias(g) for g in ("delta", "gamma", "theta", "vega")]
    return out.select("p_partkey", F.round("price", 5).alias("price"), *unit, (F.abs(F.col("market_value").cast("double") - F.col("price") * 150) < 0.00501).alias("rounded_once"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs and their lines as decisions, fills and attribution; orders without lines are runs without any."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run_id"), F.lit(30000).cast("decimal(18,2)").alias("starting_nav"), F.col("o_totalprice").cast("decimal(18,2)").alias("terminal_value"))
    lines = market._lines(spark, sf_dir).withColumnRenamed("l_orderkey", "run_id")
    value, step = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("step")
    decisions = lines.select(
        "run_id", "step", F.col("l_shipdate").cast("timestamp").alias("at"), (F.col("l_quantity") - 25).alias("delta_before"), ((F.col("l_quantity") - 25) / 2).alias("delta_after"), F.when(step % 4 != 0, value).alias("value_before"), F.when(step % 3 != 0, value - 10).cast("decimal(18,2)").alias("value_after"),
        (F.col("l_returnflag") == "R").alias("traded"),
    )
    fills = market._fills(spark, sf_dir).withColumnRenamed("l_orderkey", "run_id")
    parts = lines.select("run_id", F.col("l_discount").alias("delta_change"), F.col("l_tax").alias("gamma_change"), F.lit(1.0).alias("theta_change"), (F.col("l_tax") - F.col("l_discount")).alias("vega_change"), F.lit(0.5).alias("residual"))
    out = hedging.summary(orders, "run_id", decisions, fills, parts)
    return out.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else (F.round(c, 8).alias(c) if t == "double" else F.col(c)) for c, t in out.dtypes))


def decision_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three decisions on each session of the fifteen days from an order's, the first at ten; some ranges are reversed and empty."""
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    orders = dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate"), "o_orderkey")  # each becomes some thirty rows
    ranges = orders.select("o_orderkey", day.alias("first"), F.date_add(day, F.when(key % 9 == 0, -3).otherwise(15)).alias("last"))
    out = events.decisions(events.sessions(ranges, "first", "last", HOLIDAYS), ["09:30", "10:00", "15:15"], None, "10:00", "Asia/Kolkata")
    return out.select("o_orderkey", F.col("step").cast("long").alias("step"), "session_date", "local_time", F.date_format("decision_at", "yyyy-MM-dd HH:mm:ss").alias("decision_utc"), F.round("years", 10).alias("years"))


def option_expiries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("entry"), (F.col("o_orderkey") % 40 - 2).alias("remaining"))
    out = events.expiries(entries, "entry", "remaining", HOLIDAYS)
    return out.select("o_orderkey", "expiry_date", F.round("years_to_expiry", 10).alias("years_to_expiry"))


def own_quote_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes of provider frames against the previous close that each carries."""
    q = wire_frames.frame_quotes(spark, sf_dir).filter("reason is null")
    out = quotes.own_change(q, "last_price", "previous_close")
    return out.select("provider_key", F.round("change", 8).alias("change"), F.round("percent", 8).alias("percent"))


def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the orders of each priority."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"))
    return digests.table_digest(rows, "o_orderpriority")


def result_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results with the proof of their lines, some lines changed afterwards."""
    lines, key, step = market._lines(spark, sf_dir), F.col("l_orderkey"), F.col("step")
    name = F.concat_ws("/", F.col("l_partkey").cast("string"), step.cast("string"))
    proof = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("member_count"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", name.alias("n")))), lambda x: x["n"]), "\n"), 256).alias("member_digest")).filter(key % 31 != 0)
    kept = lines.filter((key % 7 != 0) | (step != 1))
    members = kept.select("l_orderkey", F.when(key % 7 == 0, step - 1).when((key % 13 == 0) & (step == 1), 0).otherwise(step).alias("ordinal"), F.when((key % 11 == 0) & (step == 2), F.concat(name, F.lit("x"))).otherwise(name).alias("member_id"))
    more = lines.filter((key % 17 == 0) & (step == 1)).select("l_orderkey", F.lit(99).cast("long").alias("ordinal"), name.alias("member_id"))
    return digests.membership(proof, members.unionByName(more), "l_orderkey").select("l_orderkey", F.size("members").alias("n_members"), "fault")


def committed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of sound chains, stored in three commits under the guard of their chains, one of them sent twice, beside rows that were never committed."""
    records = rec.version_records(spark, sf_dir).select("record_id", "scope_id", "recorded_at", "supersedes_record_id").filter("supersedes_record_id is null or supersedes_record_id < 1000000000")
    broken = rec.version_records(spark, sf_dir).filter("supersedes_record_id >= 1000000000").select("scope_id").distinct()
    records = records.join(broken, "scope_id", "left_anti").select("record_id", "scope_id", "recorded_at", "supersedes_record_id")
    store = Store(spark, folder(spark))
    times = [F.year("recorded_at") < 1994, F.year("recorded_at").between(1994, 1995), F.year("recorded_at") > 1995]
    for number, part in enumerate([times[0], times[1], times[1], times[2]]):
        store.append(records.filter(part), key=str(part), guard=successors)
        if number == 1:
            store.stage(records.limit(100))
    out = store.rows("record_id long, scope_id long, recorded_at timestamp, supersedes_record_id long")
    return out.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n_records"), F.max("record_id").alias("greatest"), F.count("supersedes_record_id").alias("n_superseding"))


QUERIES = {f.__name__: f for f in (leg_values, run_summary, decision_times, option_expiries, own_quote_changes, table_digests, result_members, committed_versions)}

_CLOSED = ", ".join(f"date '{d}'" for d in HOLIDAYS)
_DAYS = f"""c as (select unnest(generate_series(timestamp '1990-01-01', timestamp '2006-01-01', interval 1 day))::date as day), b as (select day, row_number() over (order by day) as n from c where isodow(day) < 6 and day not in ({_CLOSED}))"""
ORACLE_SQL = {
    "leg_values": f"select p_partkey, price, delta, gamma, theta, vega, true as rounded_once from ({market_sql._GREEKS})",
    "run_summary": f"""with {market_sql._LINES}, ss as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as st, l_quantity - 25 as d from lineitem),
vv as (select o_orderkey as run_id, -1 as st, 0 as pl, 30000::double as v from orders union all select o_orderkey, 1000000, 0, o_totalprice from orders union all select l_orderkey, st, 0, l_extendedprice from ss where st % 4 <> 0 union all select l_orderkey, st, 1, l_extendedprice - 10 from ss where st % 3 <> 0),
pp as (select run_id, max(v) over (partition by run_id order by st, pl) - v as b from vv), ww as (select run_id, round(max(b), 2) as maximum_drawdown from pp group by 1),
gg as (select l_orderkey as run_id, count(*) filter (where l_returnflag = 'R') as hedges, max(abs(d)) as m, avg(abs(d)) as a, sqrt(avg(d * d)) as r, epoch_us(max(l_shipdate)) / 1e6 - epoch_us(min(l_shipdate)) / 1e6 as seconds, sum(l_discount) as dc, sum(l_tax) as tc, count(*)::double as th, sum(l_tax - l_discount) as vc, count(*) * 0.5::double as re from ss group by 1),
tt as (select l_orderkey as run_id, sum(gross) / 100 as futures_turnover from x where kind = 'futures' group by 1)
select o_orderkey as run_id, 30000::double as starting_nav, o_totalprice as terminal_value, coalesce(hedges, 0) as hedges, round(m, 8) as greatest_delta_before, round(a, 8) as mean_delta_before, round(r, 8) as root_mean_square_delta_before, round(m / 2, 8) as greatest_delta_after, round(a / 2, 8) as mean_delta_after, round(r / 2, 8) as root_mean_square_delta_after,
round(seconds, 8) as seconds, coalesce(futures_turnover, 0)::double as futures_turnover, round(coalesce(dc, 0), 8) as delta_change, round(coalesce(tc, 0), 8) as gamma_change, round(coalesce(th, 0), 8) as theta_change, round(coalesce(vc, 0), 8) as vega_change, round(coalesce(re, 0), 8) as residual, maximum_drawdown
from orders o left join gg on gg.run_id = o_orderkey left join tt on tt.run_id = o_orderkey left join ww on ww.run_id = o_orderkey""",
    "decision_times": f"""with {_DAYS}, s as (select o_orderkey, day, row_number() over (partition by o_orderkey order by day) as n from orders join b on day between o_orderdate::date and o_orderdate::date + 15 where o_orderkey % 9 <> 0),
d as (select *, unnest(['09:30', '10:00', '15:15']) as local_time from s), e as (select *, row_number() over (partition by o_orderkey order by day, local_time) - 1 as step from d where n > 1 or local_time >= '10:00')
select o_orderkey, step, day as session_date, local_time, strftime((day || ' ' || local_time)::timestamp - interval 330 minute, '%Y-%m-%d %H:%M:%S') as decision_utc, case when step = 0 then 0 else round(1::double / 756, 10) end as years from e""",
    "option_expiries": f"""with {_DAYS}, e as (select o_orderkey, o_orderkey % 40 - 2 as k, (select min(n) from b where day >= o_orderdate::date) as n from orders)
select o_orderkey, case when k > 0 then day end as expiry_date, case when k > 0 then round(k / 252::double, 10) end as years_to_expiry from e left join b on b.n = e.n + e.k""",
    "own_quote_changes": f"""select provider_key, round(last_price - previous_close, 8) as change, round((last_price - previous_close) / previous_close * 100, 8) as percent from ({wire_frames.ORACLE_SQL["frame_quotes"]}) where reason is null""",
    "table_digests": """with h as (select o_orderpriority, sha256('{"o_custkey":"' || o_custkey || '","o_orderdate":"' || o_orderdate::date || '","o_orderkey":"' || o_orderkey || '","o_orderstatus":"' || o_orderstatus || '"}') as h from orders)
select o_orderpriority, count(*) as n_rows, count(distinct h) as n_distinct, sum(('0x' || substr(h, 1, 16))::ubigint)::varchar as sum_high, sum(('0x' || substr(h, 17, 16))::ubigint)::varchar as sum_low from h group by 1""",
    "result_members": """with n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as step from lineitem), c as (select l_orderkey as k, count(*) as n, max(step) as m from n group by 1)
select k as l_orderkey, (n - (k % 7 = 0)::int + (k % 17 = 0)::int)::int as n_members, case when k % 31 = 0 and (k % 7 <> 0 or n > 1 or k % 17 = 0) then 'unknown_result' when k % 7 = 0 and k % 17 <> 0 then 'missing_members' when k % 17 = 0 and k % 7 <> 0 then 'extra_members'
when k % 17 = 0 and k % 7 = 0 then 'broken_order' when k % 13 = 0 then 'broken_order' when k % 11 = 0 and n >= 2 then 'other_members' end as fault from c where k % 31 <> 0 or k % 7 <> 0 or n > 1 or k % 17 = 0""",
    "committed_versions": f"""with recursive {rec._T}, bad as (select distinct scope from v where target > 999999999)
select scope as scope_id, count(*) as n_records, max(id) as greatest, count(target) as n_superseding from v where scope not in (select scope from bad) group by 1""",
}
