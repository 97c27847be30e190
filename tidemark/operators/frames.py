"""Provider frames as rows: reasons of broken frames, quotes and segment states of good ones, and what became of each frame.

Frames: a key, `response` (see sources.wire; null where a frame could not be decoded), and further columns, which are kept.
Each frame and each of its entries is judged by one chain of conditions, so it has the first reason that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import conversions

# Names and limits of the provider's format and of the stored contracts.
TYPES = ("initial_feed", "live_feed", "market_info")
MODES = ("ltpc", "full_d5", "option_greeks", "full_d30")
STATES = ("PRE_OPEN_START", "PRE_OPEN_END", "NORMAL_OPEN", "NORMAL_CLOSE", "CLOSING_START", "CLOSING_END")
KINDS = {"underlying": "underlying_quote_observation", "future": "futures_quote_observation", "option": "option_quote_observation"}
MOST_FEEDS, MOST_SEGMENTS, MOST_LEVELS, FEW_LEVELS = 5000, 256, 30, 5
KEY_BYTES, SEGMENT_BYTES = 512, 128
LAST_MILLIS, SAFE = 253_402_300_799_999, 2**53
_GREEKS, _BARS = ("delta", "gamma", "rho", "theta", "vega"), ("close", "high", "interval", "low", "open", "ts", "vol")
UNADOPTED = {
    "ltpc": [],
    "indexFF": ["IndexFullFeed.marketOHLC.ohlc", *(f"OHLC.{b}" for b in _BARS)],
    "marketFF": [
        "MarketFullFeed.atp", "MarketFullFeed.iv", "MarketFullFeed.marketLevel.bidAskQuote[1:]", "MarketFullFeed.marketOHLC.ohlc", *(f"MarketFullFeed.optionGreeks.{g}" for g in _GREEKS),
        "MarketFullFeed.tbq", "MarketFullFeed.tsq", *(f"OHLC.{b}" for b in _BARS),
    ],
    "firstLevelWithGreeks": ["FirstLevelWithGreeks.iv", *(f"FirstLevelWithGreeks.optionGreeks.{g}" for g in _GREEKS)],
}


def _first(*faults: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(faults):
        out = F.when(condition, reason).otherwise(out)
    return out


def frame_fault(response: Column) -> Column:
    """Why a frame gives no rows, or null."""
    kind, ts, feeds, segments = response["type"], response["current_ts"], response["feeds"], response["info"]["segments"]
    info, count = kind == 2, F.when(segments.isNull(), 0).otherwise(F.size(segments))
    bad = lambda most: lambda e: conversions.identifier_fault(e["key"], most).isNotNull()
    return _first(
        (response.isNull(), "protobuf_decode_failed"),
        (~kind.isin(0, 1, 2), "unsupported_response_type"),
        (ts == 0, "missing_provider_timestamp"),
        ((ts < 0) | (ts > LAST_MILLIS), "invalid_provider_timestamp"),
        (F.size(feeds) > MOST_FEEDS, "too_many_feeds"),
        (count > MOST_SEGMENTS, "too_many_status_segments"),
        (F.when(info, count == 0).otherwise(F.size(feeds) == 0), "empty_primary_payload"),
        (info & F.exists(segments, bad(SEGMENT_BYTES)), "invalid_market_segment"),
        (~info & F.exists(feeds, bad(KEY_BYTES)), "invalid_provider_contract_key"),
    )


def name_of(number: Column, names: tuple[str, ...]) -> Column:
    """The name of a number, null beyond the names."""
    return F.when((number >= 0) & (number < len(names)), F.get(F.array(*map(F.lit, names)), number))


def judged(frames: DataFrame) -> DataFrame:
    """The frames with fault, response_type (where the frame was decoded so far) and secondary_paths, the payloads beside the type's own."""
    r = F.col("response")
    kind, held = r["type"], F.size(r["info"]["segments"]) > 0
    secondary = F.when((kind == 2) & (F.size(r["feeds"]) > 0), F.array(F.lit("FeedResponse.feeds"))).when(kind.isin(0, 1) & held, F.array(F.lit("FeedResponse.marketInfo.segmentStatus"))).otherwise(F.array().cast("array<string>"))
    out = frames.withColumn("fault", frame_fault(r))
    return out.withColumn("response_type", F.when(F.col("fault").isNull() | F.col("fault").isin("invalid_market_segment", "invalid_provider_contract_key"), name_of(kind, TYPES))).withColumn("secondary_paths", F.when(F.col("fault").isNull(), secondary))


def structure(feed: Column) -> Column:
    """The union that an entry has chosen, its declared and its present paths that aren't adopted, and its levels."""
    full, first = feed["full"], feed["first"]
    market, index = full["market"], full["index"]
    union = F.when(feed["ltpc"].isNotNull(), "ltpc").when(first.isNotNull(), "firstLevelWithGreeks").when(index.isNotNull(), "indexFF").when(market.isNotNull(), "marketFF")
    has = lambda c, path: F.when(c.isNotNull(), F.lit(path))
    present = F.array(has(first["greeks"], "FirstLevelWithGreeks.optionGreeks"), has(index["bars"], "IndexFullFeed.marketOHLC"), has(market["bars"], "MarketFullFeed.marketOHLC"), has(market["greeks"], "MarketFullFeed.optionGreeks"))
    levels = F.when(market.isNotNull(), F.when(market["levels"].isNull(), 0).otherwise(F.size(market["levels"]["quotes"]))).when(first.isNotNull(), first["depth"].isNotNull().cast("int")).when(union.isNotNull(), 0)
    declared = F.lit(None).cast("array<string>")
    for name, paths in UNADOPTED.items():
        declared = F.when(union == name, F.array(*map(F.lit, paths)).cast("array<string>")).otherwise(declared)
    return F.struct(union.alias("union"), F.coalesce(declared, F.array().cast("array<string>")).alias("declared"), F.filter(present, lambda p: p.isNotNull()).alias("present"), levels.alias("levels"))


def _price_fault(value: Column) -> list[tuple[Column, str]]:
    return [(F.isnan(value) | (F.abs(value) == float("inf")), "nonfinite_price"), (value < 0, "negative_price")]


def _quantity_fault(value: Column) -> list[tuple[Column, str]]:
    return [(value < 0, "invalid_quantity")]


def quotes(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row for each entry of a judged feed frame: adopted fields, or the reason why there is no quote.

    subjects: provider_key, subject_id, kind (underlying, future, option), and subject_fault where a key could not be
    resolved; keys must be unique. Sizes and times are as the provider reports them; absent levels have no bid and ask.
    """
    kept = [c for c in frames.columns if c not in ("response", "fault")]
    e = frames.filter("fault is null and response_type <> 'market_info'").select(*kept, F.col("response.current_ts").alias("_ts"), F.explode("response.feeds").alias("_e"))
    e = e.select(*kept, "_ts", F.col("_e.key").alias("provider_key"), F.col("_e.value").alias("_f")).withColumn("_s", structure(F.col("_f")))
    e = e.join(subjects.select("provider_key", "subject_id", "kind", "subject_fault", F.lit(True).alias("_known")), "provider_key", "left")
    f, union, mode, kind = F.col("_f"), F.col("_s.union"), F.col("_f.mode"), F.col("kind")
    market, first = f["full"]["market"], f["first"]
    ltpc = F.coalesce(f["ltpc"], first["ltpc"], market["ltpc"], f["full"]["index"]["ltpc"])
    level = F.when(first.isNotNull(), first["depth"]).when(F.col("_s.levels") > 0, F.get(market["levels"]["quotes"], F.lit(0)))
    volume, interest = F.coalesce(first["vtt"], market["vtt"]), F.coalesce(first["oi"], market["oi"])
    full, levels = f["full"].isNotNull(), F.col("_s.levels")
    reason = _first(
        (F.col("subject_fault").isNotNull(), "subject_fault"),
        (F.col("_known").isNull(), "unknown_provider_key"),
        (~mode.isin(0, 1, 2, 3), "request_mode_union_mismatch"),
        (f["ltpc"].isNotNull() & (mode != 0), "request_mode_union_mismatch"),
        (first.isNotNull() & (mode != 2), "request_mode_union_mismatch"),
        (first.isNotNull() & (kind != "option"), "subject_kind_mismatch"),
        (f["ltpc"].isNull() & first.isNull() & ~full, "unsupported_feed_union"),
        (full & ~mode.isin(1, 3), "request_mode_union_mismatch"),
        (union.isNull(), "unsupported_feed_union"),
        ((union == "indexFF") & (kind != "underlying"), "subject_kind_mismatch"),
        ((union == "marketFF") & (kind == "underlying"), "subject_kind_mismatch"),
        (ltpc.isNull(), "empty_supported_payload"),
        (levels > MOST_LEVELS, "depth_limit_exceeded"),
        ((union == "marketFF") & (mode == 1) & (levels > FEW_LEVELS), "request_mode_depth_mismatch"),
        *_price_fault(level["bid_p"]), *_quantity_fault(level["bid_q"]), *_price_fault(level["ask_p"]), *_quantity_fault(level["ask_q"]),
        *_quantity_fault(volume),
        (F.isnan(interest) | (interest < 0) | (interest > SAFE), "unsafe_open_interest"), (interest != F.floor(interest), "fractional_open_interest"),
        *_price_fault(ltpc["ltp"]), *_quantity_fault(ltpc["ltq"]),
        ((ltpc["ltt"] < 0) | (ltpc["ltt"] > LAST_MILLIS), "invalid_timestamp"),
        *_price_fault(ltpc["cp"]),
    )
    e = e.withColumn("reason", F.when(reason == "subject_fault", F.col("subject_fault")).otherwise(reason))
    good = F.col("reason").isNull()
    adopted = lambda c, name: F.when(good, c).alias(name)
    event = F.lit(None).cast("string")
    for k, name in KINDS.items():
        event = F.when(kind == k, name).otherwise(event)
    price = lambda c: F.when(c == 0, 0.0).otherwise(c)  # noqa: E731  no negative zero
    normalized = F.when(levels > 0, 1).otherwise(0)
    return e.select(
        *kept, "provider_key", "reason", adopted(F.col("subject_id"), "subject_id"), adopted(event, "event_type"), union.alias("feed_union"), adopted(name_of(mode, MODES), "request_mode"),
        adopted(F.col("response_type") == "initial_feed", "is_snapshot"), adopted(F.timestamp_millis("_ts"), "provider_at"),
        adopted(price(level["bid_p"]), "bid_price"), adopted(level["bid_q"], "bid_size"), adopted(price(level["ask_p"]), "ask_price"), adopted(level["ask_q"], "ask_size"),
        adopted(price(ltpc["ltp"]), "last_price"), adopted(ltpc["ltq"], "last_size"), adopted(conversions.epoch_millis(ltpc["ltt"]), "last_trade_at"), adopted(price(ltpc["cp"]), "previous_close"),
        adopted(volume, "volume"), adopted(interest.cast("long"), "open_interest"), levels.alias("levels"), adopted(normalized, "normalized_levels"), adopted(levels - normalized, "unadopted_levels"),
        F.col("_s.declared").alias("unadopted_paths"), F.col("_s.present").alias("present_paths"),
    )


def segment_states(frames: DataFrame) -> DataFrame:
    """One row for each market segment of a judged market-info frame."""
    kept = [c for c in frames.columns if c not in ("response", "fault", "secondary_paths")]
    e = frames.filter("fault is null and response_type = 'market_info'").select(*kept, F.timestamp_millis("response.current_ts").alias("provider_at"), F.explode("response.info.segments").alias("_e"))
    number = F.col("_e.value")
    known = name_of(number, STATES)
    return e.select(*kept, "provider_at", F.col("_e.key").alias("segment"), number.alias("status_number"), F.coalesce(known, F.lit("UNKNOWN")).alias("status"), known.isNotNull().alias("known"))


def results(frames: DataFrame, key: str, entries: DataFrame) -> DataFrame:
    """What became of each judged frame: its counts, its status (complete, partial, failed) and the paths of all its entries.

    entries: `quotes` of the same frames. All segments of a good market-info frame are accepted, so only quotes are counted,
    combined before the one exchange by the key.
    """
    counts = entries.groupBy(key).agg(F.count_if(F.col("reason").isNull()).alias("_a"), F.count(F.lit(1)).alias("_d"))
    good = F.col("fault").isNull()
    paths = lambda name: F.when(good, F.array_sort(F.array_distinct(F.flatten(f"_s.{name}"))))
    states = F.when(good & (F.col("response_type") == "market_info"), F.size("response.info.segments"))
    # what is wanted of a frame is taken before the exchange, which need not carry whole frames
    slim = frames.select(key, "response_type", "fault", "secondary_paths", states.alias("_states"), F.when(good, F.transform("response.feeds", lambda e: structure(e["value"]))).alias("_s"))
    slim = slim.select(key, "response_type", "fault", "secondary_paths", "_states", paths("declared").alias("unadopted_paths"), paths("present").alias("present_paths"))
    out = slim.join(counts, key, "left")
    accepted, decoded = (F.coalesce(c, F.col("_states"), F.lit(0)).cast("long") for c in (F.col("_a"), F.col("_d")))
    status = F.when(~good | (accepted == 0), "failed").when(accepted < decoded, "partial").otherwise("complete")
    return out.select(
        key, "response_type", "fault", status.alias("status"), decoded.alias("decoded"), accepted.alias("accepted"), (decoded - accepted).alias("failed"),
        "unadopted_paths", "present_paths", "secondary_paths",
    )
