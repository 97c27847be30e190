"""Registered queries over risk, positions, look-ups, lifecycles, files, feeds and streams, with the SQL that checks them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import lifecycle, lookups, positions, quotes, risk, volatility
from tidemark.plans.market import _doubles, _fills, _lines, _table
from tidemark.plans.registry import _BACKTEST, _BY, _PRICES
from tidemark.sources import feeds, files
from tidemark.sources.prices import daily_closes
from tidemark.streaming import quotes as streams

CUT = datetime.date(2000, 1, 1)


def position_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = _fills(spark, sf_dir)
    return _doubles(positions.positions(fills, ["l_orderkey"], "step"), "average_price", "mark_price", "realized", "market_value", "unrealized")


def entry_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    entries = lines.select(
        "l_orderkey", "step", F.col("l_extendedprice").alias("premium_at_risk"), (F.col("l_quantity") * 10).alias("daily_theta"), F.col("l_discount").alias("spread"),
        (F.col("l_partkey") % 3).alias("volume"), (F.col("l_suppkey") % 4).alias("open_interest"), (F.col("l_linenumber") != 3).alias("matched"),
    )
    out = risk.entry_gates(entries, 1_000_000.0, 0.04, 0.0003, 0.05, 0.01)
    return out.select("l_orderkey", "step", "rule_id", "observed", "limit", "decision", "reason")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("l_orderkey", "step", F.floor(F.col("step") / 3).alias("session"), F.round("l_extendedprice").alias("value"), F.lit(30000.0).alias("entry_value"), (F.col("l_returnflag") == "R").alias("hedged"), F.col("l_quantity"))
    return risk.marked(lines, "l_orderkey", "session", "step", "value", "entry_value", F.col("hedged"))


def risk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("l_orderkey", "step", "position_pnl", "session_pnl", "session_hedges", "total_hedges")


def state_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _marked(spark, sf_dir).withColumn("net_delta", F.col("l_quantity") - 25).withColumn("kill_switch", F.col("l_orderkey") % 50 == 0)
    out = risk.state_gates(states, 100_000.0, 0.2, 0.1, 2, 20.0)
    return out.select("l_orderkey", "step", "rule_id", "observed", "limit", "decision", "reason")


PRECEDENCE = ["daily_loss_limit", "maximum_holding_period", "insufficient_time_to_expiry", "position_loss_limit", "simulation_end"]


def exit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    flag = lambda n, name: F.when(F.col("l_partkey") % n == 0, name)
    breached = F.array_compact(F.array(flag(11, "manual_kill_switch"), flag(5, "position_loss_limit"), flag(7, "daily_loss_limit")))
    last = F.col("step") == F.max("step").over(W.partitionBy("l_orderkey"))
    reason = risk.exit_reason(breached, PRECEDENCE, F.col("l_tax"), 0.02, F.col("step"), 4, last)
    after = F.when(F.col("l_linenumber") < 3, "within_limit").when(F.col("l_linenumber") < 5, "forced_hedge").otherwise("breached")
    return lines.select("l_orderkey", "step", reason.alias("reason"), risk.after_fill(after).alias("decision"))


def newest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.newest(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


def contract_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of customers, customers of two segments as futures and options."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 5).alias("underlying"), (F.col("c_custkey") % 4).alias("expiry"), "c_mktsegment")
    of = lambda segment: customers.filter(F.col("c_mktsegment") == segment).drop("c_mktsegment")
    return lookups.contracts(_table(spark, sf_dir, "orders"), of("BUILDING"), of("MACHINERY"), "o_custkey", 2, 1).select("o_orderkey", "o_custkey")


def provider_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2")
    return lookups.bindings(lines, "l_partkey", "l_suppkey")


def wanted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookups.members(_table(spark, sf_dir, "orders"), wanted, "o_orderkey").select("o_orderkey", "o_custkey")


def resolved_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    mappings = orders.select((F.col("o_orderkey") % 9000).alias("key"), F.col("o_custkey").alias("instrument"), (F.col("o_orderdate") < "1998-06-01").alias("visible"))
    versions = orders.select(F.col("o_custkey").alias("instrument"), F.col("o_orderkey").alias("version_id"), (F.col("o_orderkey") % 9 == 0).alias("visible"))
    return lookups.subjects(spark.range(12_000).withColumnRenamed("id", "key"), mappings, versions, "key", "instrument")


def provisional_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = daily_closes(spark, sf_dir)
    live = closes.groupBy("instrument_id").agg(F.max_by(F.struct("session_date", "price"), "session_date").alias("q")).select("instrument_id", "q.*")
    live = live.withColumn("session_date", F.when(F.col("instrument_id") == "1-URGENT", F.lit(CUT) - F.expr("interval 40 days")).otherwise(F.col("session_date")).cast("date"))
    return lookups.overlay(closes.filter(F.col("session_date") < F.lit(CUT)), live)


def immutable_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    key = F.col("p_partkey")
    changed = part.filter(key % 2 == 0).withColumn("p_size", F.when(key % 5 == 0, F.lit(-1)).otherwise(F.col("p_size")))
    again = part.filter(key % 12 == 0).withColumn("p_brand", F.when(key % 24 == 0, "other").otherwise(F.col("p_brand")))
    return lookups.inserts(part.filter(key % 3 == 0), changed.unionByName(again), "p_partkey", "p_size", "p_brand").select("p_partkey", "outcome")


def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as lifecycles: ten of them in one session, states by type, and a state before each that is mostly the true one."""
    order = W.partitionBy("user_id").orderBy("event_id")
    rows = _table(spark, sf_dir, "events").withColumn("n", F.row_number().over(order) - 1).withColumn("session", F.floor(F.col("n") / 10))
    state = F.when((F.col("n") % 10 == 0) & (F.col("event_id") % 5 != 0), "connecting").when((F.col("n") % 10 == 9) & (F.col("event_id") % 4 != 0), "reconnecting").otherwise(F.col("event_type"))
    rows = rows.withColumn("state", state).withColumn("scope", F.when(F.col("event_id") % 37 == 0, F.lit(0)).otherwise(F.col("session")))
    before = F.when(F.col("n") % 10 > 0, F.lag("state").over(order))
    rows = rows.withColumn("previous_state", F.when(F.col("event_id") % 41 == 0, "none").otherwise(before))
    return rows.withColumn("source_order", F.when(F.col("event_id") % 43 == 0, F.lit(1)).otherwise(F.col("n") % 10)).withColumn("provider", F.when(F.col("event_id") % 47 == 0, "b").otherwise("a"))


def connection_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.connection_faults(_lifecycle(spark, sf_dir), "user_id", "event_id").select("event_id", "fault")


def subscription_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lifecycle(spark, sf_dir).withColumn("subscription", F.col("session")).withColumn("instruments", F.when(F.col("event_id") % 31 == 0, "y").otherwise("x"))
    rows = rows.withColumn("state", F.when(F.col("state") == "connecting", "subscribe_requested").otherwise(F.col("state"))).withColumn("previous_state", F.when(F.col("previous_state") == "connecting", "subscribe_requested").otherwise(F.col("previous_state")))
    return lifecycle.subscription_faults(rows, "user_id", "event_id").select("event_id", "fault")


def transport_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("state", F.when(F.col("event_type") == "purchase", "connected").when(F.col("event_type") == "click", "reconnecting").when(F.col("event_type") == "error", "failed").otherwise("idle"))
    return quotes.transport(rows, "user_id", "event_id", "state").select("user_id", "event_id", "attempt", "stale")


def feed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.counters(_table(spark, sf_dir, "events"), "event_type")


def cleaned_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a price file, with texts that are no dates or prices."""
    key = F.col("o_orderkey")
    date = F.when(key % 17 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    close = F.when(key % 13 == 0, "n/a").when(key % 11 == 0, F.concat(F.lit("-"), F.col("o_totalprice").cast("string"))).otherwise(F.col("o_totalprice").cast("string"))
    out = files.cleaned(_table(spark, sf_dir, "orders").select(date.alias("date"), close.alias("close"), key), "o_orderkey")
    return out.select(F.to_date("session_date").alias("session_date"), "price")


def catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's properties as one provider file; some are cut off, some repeat a key, some nest."""
    rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"]), ", ").alias("body"))
    body, user = F.col("body"), F.col("user_id")
    text = F.when(user % 7 == 0, F.concat(F.lit("["), body)).when(user % 11 == 0, F.lit('[{"k": 1, "k": 2}]')).when(user % 13 == 0, F.lit('[{"k": [1]}]')).when(user % 17 == 0, F.lit('{"k": 1}')).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return files.json_rows(rows.select("user_id", text.alias("text")), "user_id", "text")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, received = F.col("event_id"), F.col("ts").cast("timestamp")
    millis = F.unix_millis(received) + F.when(e % 19 == 0, 400_000).otherwise(0)
    price = F.when(e % 23 == 0, F.lit('"x"')).when(e % 29 == 0, F.lit("-1.5")).otherwise(F.col("value").cast("string"))
    ltpc = F.concat(F.lit('{"ltp": '), price, F.lit(', "ltt": "'), F.when(e % 37 == 0, "1e300").when(e % 41 == 0, "1e20").otherwise(millis.cast("string")), F.lit('", "ltq": "'), (e % 50 - 5).cast("string"), F.lit('", "cp": '), (e % 9).cast("string"), F.lit("}"))
    feed = F.when(e % 3 == 0, F.concat(F.lit('{"ltpc": '), ltpc, F.lit("}"))).when(e % 3 == 1, F.concat(F.lit('{"fullFeed": {"marketFF": {"ltpc": '), ltpc, F.lit("}}}"))).otherwise(F.concat(F.lit('{"fullFeed": {"indexFF": {"ltpc": '), ltpc, F.lit("}}}")))
    status = F.concat(F.lit('"marketInfo": {"segmentStatus": {"NSE": "'), F.when(e % 4 == 0, "NORMAL_OPEN").when(e % 4 == 1, "PRE_OPEN_START").when(e % 4 == 2, "NORMAL_CLOSE").otherwise("odd"), F.lit('"}}'))
    body = F.concat(F.lit('{"feeds": {"U'), F.col("user_id").cast("string"), F.lit('": '), feed, F.lit("}, "), status, F.lit("}"))
    return _table(spark, sf_dir, "events").select(e, received.alias("received"), F.when(e % 31 == 0, F.lit("{")).otherwise(body).alias("payload"))


def feed_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = _table(spark, sf_dir, "events").filter("user_id < 100").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("instrument")).distinct()
    out = feeds.feed_quotes(_messages(spark, sf_dir), "payload", "received", requested)
    return out.select("event_id", "instrument", "price", "previous_close", "last_quantity", F.unix_millis("traded_at").alias("traded_ms"))


def feed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.segment_states(_messages(spark, sf_dir), "payload").select("event_id", "segment", "state")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return events.select(F.col("user_id").alias("instrument"), F.col("value").alias("price"), F.col("ts").cast("timestamp").alias("received_at"), "event_id")


def stream_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.sequenced(_stream(spark, sf_dir))).select("instrument", "price", "sequence")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.settled(spark, streams.latest(_stream(spark, sf_dir), "event_id", "price"))


def stream_session_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.drained(spark, streams.session_closes(_stream(spark, sf_dir)))
    return out.select("instrument", F.to_date("session_start").alias("session_date"), "price", "n_quotes")


def rv_evaluation_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.evaluation_span(volatility.backtest(daily_closes(spark, sf_dir)), "ewma")


def rv_realized_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = volatility.realized_volatility(daily_closes(spark, sf_dir), 10, 260)
    return out.select("instrument_id", "session_date", F.round("realized_variance", 8).alias("realized_variance"), F.round("realized_volatility", 8).alias("realized_volatility"))


QUERIES = {
    f.__name__: f
    for f in (
        position_fold, entry_gates, risk_states, state_gates, exit_reasons, newest_records, contract_versions, provider_bindings, wanted_members, resolved_subjects, provisional_prices,
        immutable_inserts, connection_faults, subscription_faults, transport_states, feed_counters, cleaned_prices, catalogue_rows, feed_quotes, feed_segments, stream_sequences,
        stream_latest, stream_session_closes, rv_evaluation_span, rv_realized_volatility,
    )
}

_N = "n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as step from lineitem)"
_STATES = f"""{_N}, s as (select l_orderkey, step, step // 3 as session, round(l_extendedprice) as value, (l_returnflag = 'R')::int as h, l_quantity from n),
b as (select *, coalesce(lag(value) over (partition by l_orderkey order by step), 30000) as before from s),
m as (select *, value - 30000 as position_pnl, value - first(before) over (partition by l_orderkey, session order by step) as session_pnl,
 (sum(h) over (partition by l_orderkey, session order by step))::bigint as session_hedges, (sum(h) over (partition by l_orderkey order by step))::bigint as total_hedges from b)"""


def _gates(source: str, rules: list[tuple[str, str, str, str, str, str, str]]) -> str:
    """One select per rule: name, observed, limit, breach, decision on breach and else, reason on breach and else."""
    return " union all ".join(f"select l_orderkey, step, '{n}' as rule_id, ({o})::double as observed, ({m})::double as \"limit\", case when {b} then '{d.split('/')[0]}' else '{d.split('/')[1]}' end as decision, case when {b} then '{r}' else '{w}' end as reason from {source}" for n, o, m, b, d, r, w in rules)


_ENTRY = [
    (n, o, m, b, "reject/approve", f"{r}_breached", f"{r}_within_limit")
    for n, o, m, b, r in (
        ("maximum_premium_at_risk", "l_extendedprice", "40000", "l_extendedprice > 40000", "premium_at_risk"),
        ("option_spread_quality", "l_discount", "0.05", "l_discount > 0.05", "option_spread"),
        ("option_volume_quality", "l_partkey % 3", "1", "l_partkey % 3 = 0", "option_volume"),
        ("option_open_interest_quality", "l_suppkey % 4", "1", "l_suppkey % 4 = 0", "option_open_interest"),
        ("matched_straddle_integrity", "(l_linenumber <> 3)::int", "1", "l_linenumber = 3", "matched_straddle_integrity"),
        ("maximum_daily_theta", "l_quantity * 10", "300", "l_quantity * 10 > 300", "daily_theta"),
    )
] + [("minimum_expected_net_edge", "null", "0.01", "true", "not_evaluated/", "deferred_to_edge_1", "")]
_STATE = [
    (n, o, m, b, f"{d}/pass", f"{n}_{'engaged' if n == 'manual_kill_switch' else 'breached'}", f"{n}_within_limit")
    for n, o, m, b, d in (
        ("manual_kill_switch", "(l_orderkey % 50 = 0)::int", "0", "l_orderkey % 50 = 0", "exit"),
        ("daily_loss_limit", "greatest(-session_pnl, 0)", "10000", "session_pnl <= -10000", "exit"),
        ("position_loss_limit", "greatest(-position_pnl, 0)", "20000", "position_pnl <= -20000", "exit"),
        ("maximum_hedge_count", "session_hedges", "2", "session_hedges >= 2", "exit"),
        ("maximum_absolute_delta", "abs(l_quantity - 25)", "20", "abs(l_quantity - 25) > 20", "record"),
    )
]
_LIFE = """o as (select *, row_number() over (partition by user_id order by event_id) - 1 as n from events), t as (select *, n // 10 as session,
 case when n % 10 = 0 and event_id % 5 <> 0 then 'connecting' when n % 10 = 9 and event_id % 4 <> 0 then 'reconnecting' else event_type end as state,
 case when event_id % 37 = 0 then 0 else n // 10 end as scope, case when event_id % 43 = 0 then 1 else n % 10 end as source_order, case when event_id % 47 = 0 then 'b' else 'a' end as provider from o),
l as (select *, case when event_id % 41 = 0 then 'none' when n % 10 > 0 then lag(state) over u end as previous_state, lag(state) over u as before_state, lag(session) over u as before_session, lag(provider) over u as before_provider from t window u as (partition by user_id order by event_id)),
k as (select *, row_number() over s as session_place, row_number() over c as scope_place, first(scope) over s as session_scope, first(session) over c as scope_session, first(provider) over c as scope_provider,
 max(source_order) over (partition by user_id, scope order by event_id rows between unbounded preceding and 1 preceding) as prior_order,
 lag(provider) over s as sub_provider, lag(scope) over s as sub_scope, lag(state) over s as sub_state, lag(case when event_id % 31 = 0 then 'y' else 'x' end) over s as sub_instruments
 from l window s as (partition by user_id, session order by event_id), c as (partition by user_id, scope order by event_id))"""
_FEED = "case when event_id % 23 = 0 then null when event_id % 29 = 0 then null else value end"
ORACLE_SQL = {
    "position_fold": f"""with recursive {_N}, f as (select l_orderkey, step, case when step % 2 = 1 then l_quantity else -l_quantity end::bigint as q, round(l_extendedprice * 100)::bigint as p from n),
g as (select l_orderkey, 0::bigint as step, 0::bigint as h, 0::bigint as a, 0::bigint as p, 0::bigint as r from f where step = 1
 union all select g.l_orderkey, f.step, g.h + f.q,
  case when g.h = 0 or sign(g.h) = sign(f.q) then (select d.t // d.n + (2 * (d.t % d.n) > d.n or (2 * (d.t % d.n) = d.n and d.t // d.n % 2 = 1))::int from (select g.a * abs(g.h) + f.p * abs(f.q) as t, nullif(abs(g.h + f.q), 0) as n) as d)
   when g.h + f.q = 0 then 0 when sign(g.h) <> sign(g.h + f.q) then f.p else g.a end,
  f.p, case when g.h = 0 or sign(g.h) = sign(f.q) then g.r else g.r + (f.p - g.a) * least(abs(g.h), abs(f.q)) * sign(g.h) * 50 end
 from g join f on f.l_orderkey = g.l_orderkey and f.step = g.step + 1)
select l_orderkey, h as quantity, a / 100 as average_price, p / 100 as mark_price, r / 100 as realized, p * h * 50 / 100 as market_value, (p - a) * h * 50 / 100 as unrealized from g qualify row_number() over (partition by l_orderkey order by step desc) = 1""",
    "entry_gates": f"with {_N} {_gates('n', _ENTRY)}",
    "risk_states": f"with {_STATES} select l_orderkey, step, position_pnl, session_pnl, session_hedges, total_hedges from m",
    "state_gates": f"with {_STATES} {_gates('m', _STATE)}",
    "exit_reasons": f"""with {_N}, x as (select *, step = max(step) over (partition by l_orderkey) as last from n)
select l_orderkey, step, case when l_partkey % 11 = 0 then 'manual_kill_switch' when l_partkey % 7 = 0 then 'daily_loss_limit' when step >= 4 then 'maximum_holding_period' when l_tax < 0.02 then 'insufficient_time_to_expiry'
 when l_partkey % 5 = 0 then 'position_loss_limit' when last then 'simulation_end' end as reason, case when l_linenumber < 3 then 'pass' when l_linenumber < 5 then 'override' else 'exit' end as decision from x""",
    "newest_records": "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1",
    "contract_versions": """select distinct o_orderkey, o_custkey from orders left join customer f on f.c_custkey = o_custkey and f.c_mktsegment = 'BUILDING' left join customer o on o.c_custkey = o_custkey and o.c_mktsegment = 'MACHINERY'
where (f.c_nationkey % 5 = 2 and f.c_custkey % 4 = 1) or (o.c_nationkey % 5 = 2 and o.c_custkey % 4 = 1)""",
    "provider_bindings": "select l_partkey, case when count(distinct l_suppkey) = 1 then min(l_suppkey) end as l_suppkey, count(distinct l_suppkey) > 1 as corrupt from lineitem where l_linenumber <= 2 group by 1",
    "wanted_members": "select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)",
    "resolved_subjects": """with k as (select unnest(range(12000)) as key), m as (select o_orderkey % 9000 as key, count(*) filter (o_orderdate < '1998-06-01') as m, min(o_custkey) filter (o_orderdate < '1998-06-01') as i from orders group by 1),
v as (select o_custkey as i, count(*) as v, min(o_orderkey) as version_id from orders where o_orderkey % 9 = 0 group by 1),
r as (select k.key, m.i, v.version_id, case when m.m is null then 'unknown_provider_key' when m.m = 0 then 'stale_provider_mapping' when m.m > 1 then 'ambiguous_provider_mapping' when v.v is null then 'stale_provider_mapping' when v.v > 1 then 'ambiguous_contract_version' end as reason
 from k left join m using (key) left join v on v.i = m.i)
select key, case when reason is null then i end as instrument, case when reason is null then version_id end as version_id, reason from r""",
    "provisional_prices": f"""with {_PRICES}, c as (select * from p where session_date < '{CUT}'), l as (select instrument_id, max(session_date) as session_date, max_by(price, session_date) as price from p where instrument_id <> '1-URGENT' group by 1)
select *, false as provisional from c union all select *, true from l where price > 0 and session_date > (select max(session_date) from c where c.instrument_id = l.instrument_id)""",
    "immutable_inserts": """select p_partkey, case when p_partkey % 24 = 0 or (p_partkey % 12 = 0 and p_partkey % 5 = 0 and p_size <> -1) then 'collision' when p_partkey % 3 <> 0 then 'new' when p_partkey % 5 = 0 then 'collision' else 'same' end as outcome from part where p_partkey % 2 = 0""",
    "connection_faults": f"""with {_LIFE}, z as (select *, before_session is not null and before_session <> session as moved from k)
select event_id, case when moved and not (before_state = 'reconnecting' and previous_state is null and state = 'connecting' and session_place = 1 and scope_place = 1) then 'invalid_connection_reconnect_sequence' else 'invalid_connection_lifecycle_sequence' end as fault from z
where (moved and not (before_state = 'reconnecting' and previous_state is null and state = 'connecting' and session_place = 1 and scope_place = 1)) or scope <> session_scope or session <> scope_session
 or source_order <= prior_order or (not moved and before_session is not null and previous_state is distinct from before_state) or before_provider <> provider""",
    "subscription_faults": f"""with {_LIFE}, z as (select *, replace(state, 'connecting', 'subscribe_requested') as st, replace(previous_state, 'connecting', 'subscribe_requested') as ps, replace(sub_state, 'connecting', 'subscribe_requested') as ss from
 (select * replace (case when state = 'reconnecting' then 're' else state end as state, case when previous_state = 'reconnecting' then 're' else previous_state end as previous_state, case when sub_state = 'reconnecting' then 're' else sub_state end as sub_state) from k))
select event_id, 'invalid_subscription_lifecycle_sequence' as fault from z where source_order <= prior_order or session <> scope_session or provider <> scope_provider
 or (session_place = 1 and not (ps is null and st = 'subscribe_requested')) or (session_place > 1 and (sub_provider <> provider or sub_scope <> scope or sub_instruments <> case when event_id % 31 = 0 then 'y' else 'x' end or ps is distinct from ss))""",
    "transport_states": """with c as (select *, sum((event_type = 'purchase')::int) over w as g from events window w as (partition by user_id order by event_id))
select user_id, event_id, (sum((event_type = 'click')::int) over (partition by user_id, g order by event_id))::bigint as attempt, coalesce(max(case when event_type in ('click', 'error') then 1 end) over (partition by user_id, g order by event_id), 0) = 1 as stale from c""",
    "feed_counters": "select event_type, count(*) as n from events group by 1",
    "cleaned_prices": "select o_orderdate::date as session_date, max_by(o_totalprice, o_orderkey) as price from orders where o_orderkey % 17 <> 0 and o_orderkey % 13 <> 0 and o_orderkey % 11 <> 0 group by 1",
    "catalogue_rows": """select user_id, case when f is null then i else 0 end as row_number, case when f is null then r end as row, case when f is null then sha256(r) end as row_hash, f as fault from
(select user_id, row_number() over (partition by user_id order by event_id) as i, replace(props, ' ', '') as r, case when user_id % 7 = 0 then 'malformed' when user_id % 11 = 0 then 'duplicate_keys' when user_id % 13 = 0 then 'not_flat' when user_id % 17 = 0 then 'not_an_array' end as f from events) where f is null or i = 1""",
    "feed_quotes": f"""select event_id, 'U' || user_id as instrument, {_FEED} as price, nullif(event_id % 9, 0)::double as previous_close, case when event_id % 50 >= 5 then event_id % 50 - 5 end as last_quantity, epoch_us(ts) // 1000 as traded_ms
from events where user_id < 100 and event_id % 31 <> 0 and event_id % 19 <> 0 and event_id % 37 <> 0 and event_id % 41 <> 0 and {_FEED} > 0""",
    "feed_segments": "select event_id, 'NSE' as segment, case event_id % 4 when 0 then 'open' when 1 then 'pre_open' when 2 then 'closed' else 'unknown' end as state from events where event_id % 31 <> 0",
    "stream_sequences": "select user_id as instrument, value as price, row_number() over (partition by user_id order by ts) as sequence from events",
    "stream_latest": "select user_id as instrument, max(event_id) as event_id, max_by(value, event_id) as price from events group by 1",
    "stream_session_closes": "select user_id as instrument, ts::date as session_date, max_by(value, ts) as price, count(*) as n_quotes from events where ts::date + interval 1 day <= (select max(ts) from events) - interval 5 minutes group by 1, 2",
    "rv_evaluation_span": f"{_BACKTEST}, q as (select *, row_number() over ({_BY}) - 1 as k from b where f is not null and w is not null) select instrument_id, min(session_date) as evaluation_start_date, max(session_date) as evaluation_end_date, count(*) as n_obs from q where k % 5 = 0 group by 1",
    "rv_realized_volatility": f"""with {_PRICES}, v as (select *, case when count(q) over w = 10 then sum(q) over w end as x from s window w as ({_BY} rows between 9 preceding and current row))
select instrument_id, session_date, round(x, 8) as realized_variance, round(sqrt(x * 260 / 10), 8) as realized_volatility from v""",
}
