"""Plans of provider catalogues: each row accepted, a repetition, excluded or refused, and what that makes of its artifact.

Rows: artifact_id, row_number, row (one JSON object), row_hash. Fields are read from a variant, so that rows may have any
others, and with their JSON types, so that "5" is no number. A plan stands only if exactly one row content is the
profile's underlying, no provider key has two contents and no candidate is refused: counts are given in any case, the
catalogue's hash only where the plan stands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import canonical, conversions


@dataclass(frozen=True)
class Profile:
    provider: str
    version: str
    underlying_key: str
    symbol: str
    exchange: str
    currency: str
    index_segment: str
    derivative_segment: str
    symbols: tuple[str, ...]
    multiplier: int = 1


def _typed(name: str, *kinds: str) -> Column:
    """Whether a field is there with one of some JSON types."""
    kind = F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))
    return F.coalesce(F.regexp_extract(kind, r"^[A-Z]+", 0).isin(*kinds), F.lit(False))


def _text(name: str) -> Column:
    """A text field that isn't blank, or null."""
    value = F.try_variant_get("_v", f"$.{name}", "string")
    return F.when(_typed(name, "STRING") & (F.trim(value) != ""), value)


def _number(name: str) -> Column:
    """A JSON number as a decimal, or null."""
    return F.when(_typed(name, "BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get("_v", f"$.{name}", "decimal(28,10)"))


def outcomes(rows: DataFrame, profile: Profile) -> DataFrame:
    """Each row with its disposition, reason, and, where it is accepted, its projection, ids and normalized hash."""
    p, lit = profile, F.lit
    r = rows.withColumn("_v", F.try_parse_json("row"))
    key, under, kind, lot, tick, strike, millis = _text("instrument_key"), _text("underlying_key"), _text("instrument_type"), _number("lot_size"), _number("tick_size"), _number("strike_price"), _number("expiry")
    r = r.select(
        *rows.columns, key.alias("provider_key"), under.alias("_under"), kind.alias("_kind"), lot.alias("_lot"), tick.alias("_tick"), strike.alias("_strike"), millis.alias("_millis"), _text("segment").alias("_segment"), _text("exchange").alias("_exchange"),
        _text("underlying_type").alias("_under_type"), F.upper(F.replace(F.trim(_text("underlying_symbol")), lit("_"), lit(" "))).alias("_symbol"), _text("trading_symbol").alias("display_symbol"),
    )
    own, candidate = F.col("provider_key") == p.underlying_key, F.coalesce((F.col("provider_key") == p.underlying_key) | (F.col("_under") == p.underlying_key), lit(False))
    r = r.withColumn("_own", F.coalesce(own, lit(False))).withColumn("_candidate", candidate)
    by_content, by_key = W.partitionBy("artifact_id", "row_hash", "_candidate"), W.partitionBy("artifact_id", "provider_key", "_candidate")
    r = r.withColumn("_first", F.min("row_number").over(by_content)).withColumn("_clash", F.min("row_hash").over(by_key) != F.max("row_hash").over(by_key))
    derivative = ~F.col("_own")
    whole = lambda c: F.col(c) == F.floor(F.col(c))
    fine = lambda c: F.coalesce(c, lit(False))
    reason = (
        F.when(F.col("provider_key").isNull(), "instrument_key")
        .when(~fine(F.col("_segment") == F.when(derivative, p.derivative_segment).otherwise(p.index_segment)), "segment")
        .when(~fine(F.col("_exchange") == p.exchange), "exchange")
        .when(derivative & ~fine(F.col("_under_type") == "INDEX"), "underlying_type")
        .when(derivative & ~fine(F.col("_symbol").isin(*p.symbols)), "underlying_symbol")
        .when(~fine(F.when(derivative, F.col("_kind").isin("FUT", "CE", "PE")).otherwise(F.col("_kind") == "INDEX")), "instrument_type")
        .when(derivative & ~fine(whole("_millis") & F.col("_millis").between(0, 253_402_300_799_999)), "expiry")
        .when(~fine(whole("_lot") & (F.col("_lot") > 0)), "lot_size")
        .when(~fine(F.col("_tick") > 0), "tick_size")
        .when(F.col("display_symbol").isNull(), "trading_symbol")
        .when(derivative & (F.col("_kind") != "FUT") & ~fine(F.col("_strike") > 0), "strike_price")
        .when(F.col("_clash"), "conflicting_provider_key")
    )
    repeated = F.col("row_number") > F.col("_first")
    r = r.withColumn("reason", F.when(~F.col("_candidate"), "excluded_by_profile").when(repeated, "exact_duplicate").otherwise(reason))
    state = F.when(F.col("reason").isNull(), "accepted").when(F.col("reason").isin("excluded_by_profile", "exact_duplicate"), F.col("reason")).otherwise("refused")
    r = r.withColumn("disposition", state).withColumn("kind", F.when(F.col("_own"), "underlying").when(F.col("_kind") == "FUT", "future").otherwise("option"))
    good = F.col("disposition") == "accepted"
    r = r.select(
        *rows.columns, "provider_key", "disposition", "reason", F.when(good, F.col("kind")).alias("kind"), F.when(good & derivative, conversions.expiry_date(F.col("_millis"))).alias("expiry"), F.when(good & (F.col("kind") == "option"), F.col("_strike")).alias("strike"),
        F.when(good & (F.col("kind") == "option"), F.when(F.col("_kind") == "CE", "call").otherwise("put")).alias("option_side"), F.when(good, F.col("_lot").cast("long")).alias("lot_size"), F.when(good, (F.col("_tick") / 100).cast("decimal(28,12)")).alias("tick_size"), F.when(good, F.col("display_symbol")).alias("display_symbol"), "_own",
    )
    base = canonical.underlying_id(lit(p.exchange), lit(p.symbol), lit("index"), lit(p.currency))
    contract = F.when(F.col("kind") == "underlying", base).when(F.col("kind") == "future", canonical.futures_id(lit(p.exchange), base, F.col("expiry"), lit("cash"), lit(p.multiplier), lit(p.currency)))
    contract = contract.when(F.col("kind") == "option", canonical.option_id(lit(p.exchange), base, F.col("expiry"), F.col("strike"), F.col("option_side"), lit("european"), lit("cash"), lit(p.multiplier), lit(p.currency)))
    meaning, occurrence = canonical.source_row_ids(lit(p.provider), lit(p.version), F.col("artifact_id"), F.col("row_number"), F.col("row_hash"))
    return r.withColumn("instrument_id", contract).withColumn("projection", _projection(p, base)).withColumn("normalized_hash", F.when(F.col("projection").isNotNull(), canonical.digest(F.col("projection")))).withColumn("semantic_id", meaning).withColumn("occurrence_id", occurrence)


def _projection(p: Profile, base: Column) -> Column:
    """Canonical JSON of what a row means, by its kind; null where it isn't accepted."""

    def of(kind: str, **more: tuple[Column, str]) -> Column:
        fixed = {k: (F.lit(v), "string") for k, v in (("kind", kind), ("exchange", p.exchange), ("currency", p.currency), ("trading_status", "active"))}
        own = {"provider_contract_key": (F.col("provider_key"), "string"), "lot_size": (F.col("lot_size"), "bigint"), "tick_size": (F.col("tick_size"), "decimal(28,12)"), "display_symbol": (F.col("display_symbol"), "string")}
        return F.when(F.col("kind") == kind, canonical.flat(**fixed, **own, **more))

    text = lambda v: (F.lit(v), "string")
    derived = {"underlying_instrument_id": (base, "string"), "expiry": (F.col("expiry"), "date"), "settlement_type": text("cash"), "multiplier": (F.lit(p.multiplier), "int")}
    option = {"strike": (F.col("strike"), "decimal(28,10)"), "option_side": (F.col("option_side"), "string"), "exercise_style": text("european")}
    return F.coalesce(of("underlying", canonical_symbol=text(p.symbol), instrument_type=text("index")), of("future", **derived), of("option", **derived, **option))


def plans(judged: DataFrame) -> DataFrame:
    """For each artifact of `outcomes` its counts, fault, field fingerprint and catalogue hash.

    The catalogue's hash covers the accepted projections, sorted by their own hashes. It gathers one artifact's projections in
    one group, as the contract's limit of 250 MiB for an artifact allows.
    """
    count = lambda name: F.count_if(F.col("disposition") == name)
    each = judged.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("physical_rows"), count("accepted").alias("accepted"), count("exact_duplicate").alias("duplicates"), count("excluded_by_profile").alias("excluded"), count("refused").alias("refused"),
        F.count_distinct(F.when(F.col("_own"), F.col("row_hash"))).alias("_own"), F.min(F.when(F.col("disposition") == "refused", F.struct("row_number", "reason"))).alias("_fault"),
        F.array_sort(F.collect_list(F.when(F.col("disposition") == "accepted", F.struct(F.col("normalized_hash").alias("h"), F.col("projection").alias("j"))))).alias("_items"),
    )
    fields = judged.select("artifact_id", F.explode(F.json_object_keys("row")).alias("field")).distinct().groupBy("artifact_id").agg(F.array_sort(F.collect_list("field")).alias("_fields"))
    out = each.join(fields, "artifact_id", "left")
    fault = F.when(F.col("_own") == 0, "missing_underlying").when(F.col("_own") > 1, "duplicate_underlying").otherwise(F.col("_fault.reason"))
    items = F.concat(F.lit('{"entity":"normalized_provider_catalogue","items":['), F.array_join(F.transform("_items", lambda i: i["j"]), ","), F.lit("]}"))
    fingerprint = canonical.hashed(entity="catalogue_field_fingerprint", fields=(F.coalesce("_fields", F.array().cast("array<string>")), "array<string>"))
    return out.select("artifact_id", "physical_rows", "accepted", "duplicates", "excluded", "refused", fault.alias("fault"), fingerprint.alias("field_fingerprint"), F.when(fault.isNull(), canonical.digest(items)).alias("catalogue_hash"))
