"""Registered queries over provider frames, with the SQL that checks them.

The frames are made of events, four to a frame, written in the provider's format and decoded again. The rules by which
some of them are cut off, of no bytes, of unknown types or modes, or hold impossible values are the same in Spark and SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import constraints
from tidemark.operators import frames as fr
from tidemark.sources import wire


def _every(key: Column, n: int, value, otherwise) -> Column:
    return F.when(key % n == 0, value).otherwise(otherwise)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    E = F.col("event_id")  # noqa: N806
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("frame_id", F.expr("event_id div 4")).withColumn("u", E % 6)


def _feed() -> Column:
    E, null, value, u = F.col("event_id"), F.lit(None), F.col("value"), F.col("u")  # noqa: N806
    d = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    n = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    ltp = _every(E, 31, -value, _every(E, 37, float("nan"), _every(E, 43, float("inf"), value)))
    ltt = _every(E, 53, n(-7), _every(E, 59, n(0), _every(E, 61, n(2**60), F.unix_millis("ts"))))
    ltpc = F.struct(d(ltp).alias("ltp"), ltt.alias("ltt"), n(_every(E, 41, -1, E % 1000)).alias("ltq"), d(_every(E, 47, -1.0, value + 1)).alias("cp"))
    some = F.when(E % 67 != 0, ltpc)
    level = lambda i: F.struct(n(_every(E, 73, -2, i + 1)).alias("bid_q"), d(_every(E, 71, -1.0, value - (i + 1) * 0.01)).alias("bid_p"), n(2).alias("ask_q"), d(value + (i + 1) * 0.01).alias("ask_p"))
    greeks = F.when(E % 2 == 0, F.struct(*(d(0.5).alias(g) for g in ("delta", "theta", "gamma", "vega", "rho"))))
    bars = F.when(E % 3 == 0, F.struct(F.array(F.struct(F.lit("I1").alias("interval"), *(d(value).alias(c) for c in ("open", "high", "low", "close")), n(1).alias("vol"), n(2).alias("ts"))).alias("bars")))
    levels = F.when(E % 34 > 0, F.struct(F.transform(F.sequence(F.lit(0), (E % 34 - 1).cast("int")), level).alias("quotes")))
    volume, interest = n(_every(E, 79, -1, E)).alias("vtt"), d(_every(E, 83, 0.5, _every(E, 89, -1.0, _every(E, 97, 1e17, E % 5000)))).alias("oi")
    market = F.struct(some.alias("ltpc"), levels.alias("levels"), greeks.alias("greeks"), bars.alias("bars"), d(1.0).alias("atp"), volume, interest, d(0.2).alias("iv"), d(3.0).alias("tbq"), d(4.0).alias("tsq"))
    full = F.struct(F.when(u.isin(2, 5), market).alias("market"), F.when(u == 1, F.struct(some.alias("ltpc"), bars.alias("bars"))).alias("index"))
    first = F.struct(some.alias("ltpc"), F.when(E % 4 != 3, level(F.lit(0))).alias("depth"), greeks.alias("greeks"), volume, interest, d(0.2).alias("iv"))
    proper = F.when(u == 0, 0).when(u == 3, 2).otherwise(_every(E, 2, 1, 3))
    mode = _every(E, 7, F.expr("event_id div 7 % 5"), proper).cast("int")
    return F.struct(F.when(u == 0, ltpc).otherwise(null).alias("ltpc"), F.when(u.isin(1, 2, 5) | (u == 4) & (E % 4 == 0), full).alias("full"), F.when(u == 3, first).alias("first"), mode.alias("mode"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, frame) of all events."""
    E, ID = F.col("event_id"), F.col("frame_id")  # noqa: N806
    e = _events(spark, sf_dir)
    key = F.concat(_every(ID, 29, " SEG|", "SEG|"), E.cast("string"))
    grouped = e.groupBy("frame_id").agg(F.collect_list(F.struct(key.alias("key"), _feed().alias("value"))).alias("feeds"), F.min("ts").alias("ts"))
    kind = F.when(ID % 9 == 8, 2).when(ID % 9 == 7, 5).otherwise(ID % 2).cast("int")
    ts = _every(ID, 13, F.lit(0).cast("long"), _every(ID, 17, F.lit(-5).cast("long"), _every(ID, 101, F.lit(2**60), F.unix_millis("ts"))))
    segment = lambda key, value: F.struct(key.alias("key"), value.cast("int").alias("value"))
    segments = F.array(segment(F.when(ID % 36 == 8, "X\u0001").otherwise(F.concat(F.lit("A_"), (ID % 3).cast("string"))), ID % 8), segment(F.lit("B"), ID % 7))
    info = F.when((ID % 9 == 8) & (ID % 45 != 8) | (ID % 6 == 0), F.struct(segments.alias("segments")))
    feeds = F.when(ID % 23 == 0, F.filter("feeds", lambda x: F.lit(False))).otherwise(F.col("feeds"))
    out = wire.encoded(grouped.select("frame_id", F.struct(kind.alias("type"), feeds.alias("feeds"), ts.alias("current_ts"), info.alias("info")).alias("v")), "v")
    unknown = F.unhex(F.lit("788501"))  # field 15, which no message knows
    frame = F.when(ID % 19 == 0, F.expr("substring(frame, 1, octet_length(frame) - 1)")).when(ID % 5 == 0, F.concat("frame", unknown)).otherwise(F.col("frame"))
    return out.select("frame_id", frame.alias("frame"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    E, u = F.col("event_id"), F.col("u")  # noqa: N806
    kind = _every(E, 11, "future", F.when(u.isin(0, 1, 4), "underlying").when(u == 2, "future").otherwise("option"))
    rows = _events(spark, sf_dir).filter(E % 13 != 0)
    return rows.select(F.concat(F.lit("SEG|"), E.cast("string")).alias("provider_key"), F.concat(F.lit("sub"), F.col("user_id").cast("string")).alias("subject_id"), kind.alias("kind"), F.when(E % 17 == 0, "stale_provider_mapping").alias("subject_fault"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.judged(wire.decoded(frames(spark, sf_dir), "frame"))


def _joined(*names: str) -> list[Column]:
    return [F.array_join(n, ",").alias(n) for n in names]


def frame_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fr.quotes(_judged(spark, sf_dir), subjects(spark, sf_dir))
    lists = ("secondary_paths", "unadopted_paths", "present_paths")
    return q.select(*(c for c in q.columns if c not in lists), *_joined(*lists))


def frame_segment_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.segment_states(_judged(spark, sf_dir))


def frame_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    out = fr.results(judged, "frame_id", fr.quotes(judged, subjects(spark, sf_dir)))
    lists = ("secondary_paths", "unadopted_paths", "present_paths")
    return out.select(*(c for c in out.columns if c not in lists), *_joined(*lists))


#: For each rule of quotes the change that breaks it, applied to the events whose id leaves its place as the remainder.
_BREAKS = [
    ("identity_differs", "identity_subject_id", "'other'"), ("text_missing", "provider_key", "' '"), ("provider_differs", "subject_provider", "'other'"), ("provider_key_differs", "subject_provider_key", "'other'"),
    ("mapping_differs", "subject_mapping_id", "'other'"), ("version_differs", "subject_version_id", "null"), ("subject_differs", "subject_subject_id", "'other'"), ("event_type_differs", "event_type", "'futures_quote_observation'"),
    ("response_type", "response_type", "'market_info'"), ("mode_of_union", "request_mode", "'ltpc'"), ("kind_of_union", "feed_union", "'indexFF'"), ("snapshot_differs", "is_snapshot", "true"), ("scope_too_long", "scope_id", "repeat('s', 513)"),
    ("source_order", "source_order", "-1"), ("sequence_given", "provider_sequence", "event_id"), ("schema_version", "schema_version", "2"), ("presence_semantics", "presence_semantics", "'none'"), ("numeric_basis", "numeric_basis", "null"),
    ("price", "ask_price", "-value - 1"), ("quantity", "volume", "-1"), ("open_interest", "open_interest", "9007199254740993"), ("levels", "levels", "31"), ("normalized_levels", "normalized_levels", "2"), ("unadopted_levels", "unadopted_levels", "-1"),
    ("levels_differ", "unadopted_levels", "9"), ("levels_of_union", "normalized_levels", "0"), ("unadopted_paths", "unadopted_paths", "array('b', 'a')"), ("present_paths", "present_paths", "array('a b')"), ("secondary_paths", "secondary_paths", "array('a', 'a')"),
    ("clock_missing", "available_at", "null"), ("recorded_before_available", "recorded_at", "available_at - interval 1 second"), ("available_before_received", "received_at", "available_at + interval 1 second"), ("basis_unknown", "availability_basis", "'guessed'"),
    ("receipt_missing", "received_at", "null"), ("receipt_differs", "received_at", "available_at - interval 1 second"), ("receipt_of_import", "availability_basis", "'historical_import'"),
]


def quote_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes made of events, most of which break one rule or more."""
    user, key = "cast(user_id as string)", "concat('SEG|', event_id)"
    good = {
        "raw_event_id": "cast(event_id as string)", "identity_raw_event_id": "cast(event_id as string)", "identity_subject_id": user, "subject_id": user, "subject_subject_id": user, "provider": "'p'", "subject_provider": "'p'",
        "provider_key": key, "subject_provider_key": key, "mapping_id": "'m'", "subject_mapping_id": "'m'", "version_id": "'v'", "subject_version_id": "'v'", "scope_id": "'s'", "kind": "'option'", "event_type": "'option_quote_observation'",
        "response_type": "'live_feed'", "request_mode": "'full_d5'", "feed_union": "'marketFF'", "is_snapshot": "false", "source_order": "event_id", "provider_sequence": "cast(null as bigint)", "supersedes_event_id": "cast(null as string)",
        "schema_version": "1", "identity_schema_version": "1", "presence_semantics": "'proto3_parent_implied_v1'", "numeric_basis": "'protobuf_double_roundtrip_decimal_v1'", "bid_price": "value", "ask_price": "value + 1", "last_price": "value",
        "previous_close": "cast(null as double)", "bid_size": "1L", "ask_size": "2L", "last_size": "cast(null as bigint)", "volume": "event_id", "open_interest": "event_id", "levels": "3", "normalized_levels": "1", "unadopted_levels": "2",
        "unadopted_paths": "array('a', 'b')", "present_paths": "cast(array() as array<string>)", "secondary_paths": "cast(array() as array<string>)", "received_at": "ts", "available_at": "ts", "recorded_at": "ts + interval 1 second", "availability_basis": "'received'",
    }
    events = _events(spark, sf_dir).filter("value >= 0")
    rows = events.select("event_id", "value", *(F.expr(sql).alias(name) for name, sql in good.items()))
    change = lambda name: [(i, sql) for i, (_, column, sql) in enumerate(_BREAKS) if column == name]
    broken = {n: f"case {' '.join(f'when event_id % 41 = {i} then {sql}' for i, sql in change(n))} else {n} end" for n in good if change(n)}
    rows = rows.select("event_id", *(F.expr(broken.get(n, n)).alias(n) for n in good))
    out = constraints.judged(rows, constraints.quote_rules())
    return out.select("event_id", F.array_join("broken", ",").alias("broken"), "accepted")


QUERIES = {f.__name__: f for f in (frame_quotes, frame_segment_states, frame_results, quote_rules)}

#: What a change breaks besides its own rule, by the rules' order.
_BESIDES = {
    "text_missing": "text_missing,provider_key_differs", "response_type": "response_type", "kind_of_union": "kind_of_union,levels_of_union", "snapshot_differs": "snapshot_differs", "schema_version": "schema_version",
    "levels": "levels,levels_differ,levels_of_union", "normalized_levels": "normalized_levels,levels_differ,levels_of_union", "unadopted_levels": "unadopted_levels,levels_differ", "levels_of_union": "levels_differ,levels_of_union",
    "available_before_received": "available_before_received,receipt_differs", "clock_missing": "clock_missing", "basis_unknown": "basis_unknown",
}


def _paths(name: str) -> str:
    return "[" + ", ".join(f"'{p}'" for p in fr.UNADOPTED[name]) + "]::varchar[]"


_F = """f as (select event_id // 4 as frame_id, min(ts) as ts, count(*) as n, array_agg(event_id) as ids from events group by 1),
g as (select *, case when frame_id % 9 = 8 then 2 when frame_id % 9 = 7 then 5 else frame_id % 2 end as t,
case when frame_id % 13 = 0 then 0 when frame_id % 17 = 0 then -5 when frame_id % 101 = 0 then 1152921504606846976 else epoch_us(ts) // 1000 end as ms,
case when frame_id % 23 = 0 then 0 else n end as n_feeds, case when (frame_id % 9 = 8 and frame_id % 45 <> 8) or frame_id % 6 = 0 then 2 else 0 end as n_segments from f),
j as (select *, case when frame_id % 19 = 0 or (t = 0 and n_feeds + n_segments + ms = 0 and frame_id % 5 <> 0) then 'protobuf_decode_failed' when t = 5 then 'unsupported_response_type' when ms = 0 then 'missing_provider_timestamp'
when ms < 0 or ms > 253402300799999 then 'invalid_provider_timestamp' when (case when t = 2 then n_segments else n_feeds end) = 0 then 'empty_primary_payload'
when t = 2 and frame_id % 36 = 8 then 'invalid_market_segment' when t <> 2 and frame_id % 29 = 0 then 'invalid_provider_contract_key' end as fault,
case when t = 2 and n_feeds > 0 then 'FeedResponse.feeds' when t < 2 and n_segments > 0 then 'FeedResponse.marketInfo.segmentStatus' else '' end as secondary from g),
s as (select e.*, event_id // 4 as frame_id, event_id % 6 as u, case when event_id % 7 = 0 then event_id // 7 % 5 when event_id % 6 = 0 then 0 when event_id % 6 = 3 then 2 when event_id % 2 = 0 then 1 else 3 end as m,
event_id % 67 <> 0 or event_id % 6 = 0 as has, case when event_id % 6 in (2, 5) then event_id % 34 when event_id % 6 = 3 then (event_id % 4 <> 3)::int when event_id % 6 < 2 then 0 end as levels,
case when event_id % 11 = 0 then 'future' when event_id % 6 in (0, 1, 4) then 'underlying' when event_id % 6 = 2 then 'future' else 'option' end as kind from events e),
p as (select *, case u when 0 then 'ltpc' when 1 then 'indexFF' when 2 then 'marketFF' when 5 then 'marketFF' when 3 then 'firstLevelWithGreeks' end as feed_union,
case when u in (2, 3, 5) and levels > 0 then 1 else 0 end as book from s),
r as (select *, case when event_id % 13 = 0 then 'unknown_provider_key' when event_id % 17 = 0 then 'stale_provider_mapping' when m = 4 then 'request_mode_union_mismatch'
when u = 0 and m <> 0 then 'request_mode_union_mismatch' when u = 3 and m <> 2 then 'request_mode_union_mismatch' when u = 3 and kind <> 'option' then 'subject_kind_mismatch'
when u = 4 and event_id % 4 <> 0 then 'unsupported_feed_union' when u in (1, 2, 4, 5) and m not in (1, 3) then 'request_mode_union_mismatch' when u = 4 then 'unsupported_feed_union'
when u = 1 and kind <> 'underlying' then 'subject_kind_mismatch' when u in (2, 5) and kind = 'underlying' then 'subject_kind_mismatch' when not has then 'empty_supported_payload'
when levels > 30 then 'depth_limit_exceeded' when u in (2, 5) and m = 1 and levels > 5 then 'request_mode_depth_mismatch'
when book = 1 and (event_id % 71 = 0 or value - 0.01::double < 0) then 'negative_price' when book = 1 and event_id % 73 = 0 then 'invalid_quantity'
when u in (2, 3, 5) and event_id % 79 = 0 then 'invalid_quantity'
when u in (2, 3, 5) and event_id % 83 = 0 then 'fractional_open_interest' when u in (2, 3, 5) and (event_id % 89 = 0 or event_id % 97 = 0) then 'unsafe_open_interest'
when event_id % 31 = 0 and value > 0 then 'negative_price' when event_id % 31 = 0 then null when event_id % 37 = 0 or event_id % 43 = 0 then 'nonfinite_price' end as early from p),
x as (select *, coalesce(early, case when event_id % 41 = 0 then 'invalid_quantity' when event_id % 53 = 0 then 'invalid_timestamp' when event_id % 59 = 0 then null when event_id % 61 = 0 then 'invalid_timestamp' end,
case when event_id % 47 = 0 then 'negative_price' end) as reason from r),
""" + f"""y as (select *, case feed_union when 'ltpc' then {_paths("ltpc")} when 'indexFF' then {_paths("indexFF")} when 'marketFF' then {_paths("marketFF")} when 'firstLevelWithGreeks' then {_paths("firstLevelWithGreeks")} else []::varchar[] end as declared,
list_filter([case when u = 3 and event_id % 2 = 0 then 'FirstLevelWithGreeks.optionGreeks' end, case when u = 1 and event_id % 3 = 0 then 'IndexFullFeed.marketOHLC' end,
case when u in (2, 5) and event_id % 3 = 0 then 'MarketFullFeed.marketOHLC' end, case when u in (2, 5) and event_id % 2 = 0 then 'MarketFullFeed.optionGreeks' end], lambda v: v is not null) as present from x)"""
_TYPE = "case t when 0 then 'initial_feed' when 1 then 'live_feed' when 2 then 'market_info' end"


def _good(sql: str, name: str) -> str:
    return f"case when reason is null then {sql} end as {name}"


ORACLE_SQL = {
    "frame_quotes": f"""with {_F} select y.frame_id, {_TYPE} as response_type, 'SEG|' || event_id as provider_key, reason, {_good("'sub' || user_id", "subject_id")},
{_good("case kind when 'underlying' then 'underlying_quote_observation' when 'future' then 'futures_quote_observation' else 'option_quote_observation' end", "event_type")}, feed_union,
{_good("['ltpc', 'full_d5', 'option_greeks', 'full_d30'][m + 1]", "request_mode")}, {_good("t = 0", "is_snapshot")}, {_good("make_timestamp(ms * 1000)", "provider_at")},
{_good("case when book = 1 then value - 0.01::double end", "bid_price")}, {_good("case when book = 1 then 1 end", "bid_size")}, {_good("case when book = 1 then value + 0.01::double end", "ask_price")}, {_good("case when book = 1 then 2 end", "ask_size")},
{_good("value", "last_price")}, {_good("event_id % 1000", "last_size")}, {_good("case when event_id % 59 <> 0 then make_timestamp(epoch_us(y.ts) // 1000 * 1000) end", "last_trade_at")}, {_good("value + 1", "previous_close")},
{_good("case when u in (2, 3, 5) then event_id end", "volume")}, {_good("case when u in (2, 3, 5) then event_id % 5000 end", "open_interest")}, levels::int as levels, {_good("book", "normalized_levels")}, {_good("(levels - book)::int", "unadopted_levels")},
secondary as secondary_paths, array_to_string(declared, ',') as unadopted_paths, array_to_string(present, ',') as present_paths from y join j using (frame_id) where fault is null and t <> 2""",
    "frame_segment_states": f"""with {_F}, z as (select frame_id, ms, unnest([{{'segment': 'A_' || frame_id % 3, 'n': frame_id % 8}}, {{'segment': 'B', 'n': frame_id % 7}}]) as v from j where fault is null and t = 2)
select frame_id, 'market_info' as response_type, make_timestamp(ms * 1000) as provider_at, v.segment as segment, v.n::int as status_number, coalesce(['PRE_OPEN_START', 'PRE_OPEN_END', 'NORMAL_OPEN', 'NORMAL_CLOSE', 'CLOSING_START', 'CLOSING_END'][v.n + 1], 'UNKNOWN') as status, v.n < 6 as known from z""",
    "frame_results": f"""with {_F}, c as (select frame_id, count(*) filter (where reason is null) as a, count(*) as d, list_sort(list_distinct(flatten(list(declared)))) as un, list_sort(list_distinct(flatten(list(present)))) as pr from y group by 1),
k as (select j.*, case when fault is not null then 0 when t = 2 then 2 else a end as accepted, case when fault is not null then 0 when t = 2 then 2 else d end as decoded, n_feeds > 0 as fed, un, pr from j left join c using (frame_id))
select frame_id, case when fault is null or fault like 'invalid_market%' or fault like '%contract_key' then {_TYPE} end as response_type, fault, case when accepted = 0 then 'failed' when accepted < decoded then 'partial' else 'complete' end as status, decoded::bigint as decoded, accepted::bigint as accepted, (decoded - accepted)::bigint as failed,
case when fault is null then secondary end as secondary_paths, case when fault is null then array_to_string(case when fed then un else [] end, ',') end as unadopted_paths, case when fault is null then array_to_string(case when fed then pr else [] end, ',') end as present_paths from k""",
    "quote_rules": f"""select event_id, coalesce([{", ".join(f"'{_BESIDES.get(name, name)}'" for name, _, _ in _BREAKS)}][event_id % 41 + 1], '') as broken, event_id % 41 >= {len(_BREAKS)} as accepted from events where value >= 0""",
}
