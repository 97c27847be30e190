"""Reads over stored records: versions, mappings and sessions with their records, listings of observations and states, instruments of a provider's rows.

All joins are by ids; a condition on one side is applied before its join, so that it reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_records(values: DataFrame, records: DataFrame, key: str, known_as_of=None, **wanted) -> DataFrame:
    """Values (versions, mappings, catalogues, sessions) with their temporal record (key, record_id, recorded_at, supersedes_record_id), as known at a moment (null: all), where some columns have wanted values."""
    for column, value in wanted.items():
        values = values.filter(F.col(column) == value)
    known = records if known_as_of is None else records.filter(F.col("recorded_at") <= F.lit(known_as_of))
    return values.join(known.select(key, "record_id", "recorded_at", "supersedes_record_id"), key)


def mapped(mappings: DataFrame, records: DataFrame, versions: DataFrame, provider_key, known_as_of=None) -> DataFrame:
    """A provider key's mappings with their records and the instruments of their versions (version_id, instrument_id)."""
    return with_records(mappings, records, "mapping_id", known_as_of, provider_key=provider_key).join(versions.select("version_id", "instrument_id"), "version_id")


def identified(registry: DataFrame, **kinds: DataFrame) -> DataFrame:
    """Each registered instrument (instrument_id, kind) with its row of its own kind's table as a struct; `lost` where that has none."""
    out = registry
    for name, frame in kinds.items():
        body = F.struct(*(c for c in frame.columns if c != "instrument_id")).alias(name)
        out = out.join(frame.select("instrument_id", body, F.lit(name).alias(f"_{name}")), (registry["instrument_id"] == frame["instrument_id"]) & (registry["kind"] == name), "left").drop(frame["instrument_id"])
    held = F.coalesce(*(F.col(f"_{n}") for n in kinds))
    return out.withColumn("lost", held.isNull()).drop(*(f"_{n}" for n in kinds))


def observations(events: DataFrame, members: DataFrame, subject, limit: int, *order: str) -> DataFrame:
    """The first events of a subject, in order, that some stored result holds (members: event_id), each once however many hold it."""
    return events.filter(F.col("subject_id") == subject).join(members.select("event_id"), "event_id", "left_semi").orderBy(*order).limit(limit)


def states(statuses: DataFrame, members: DataFrame, provider, limit: int) -> DataFrame:
    """The latest segment states of a provider that some stored result holds, by provider time and event id, latest first. Keys: event_id and schema_version."""
    keys = ["event_id", "schema_version"]
    return statuses.filter(F.col("provider") == provider).join(members.select(*keys), keys, "left_semi").orderBy(F.desc("provider_at"), F.desc("event_id")).limit(limit)


def resolution_faults(resolutions: DataFrame) -> DataFrame:
    """What breaks the contract of resolution batches (batch, place, provider_key, subject_id, failure): a key twice, resolved and failed or neither, or out of order."""
    order = W.partitionBy("batch").orderBy("place")
    same = W.partitionBy("batch", "provider_key")
    both = F.col("subject_id").isNotNull() == F.col("failure").isNotNull()
    fault = F.when(F.count(F.lit(1)).over(same) > 1, "repeated_key").when(both, "resolved_and_failed").when(F.col("provider_key") < F.lag("provider_key").over(order), "out_of_order")
    return resolutions.withColumn("fault", fault).filter("fault is not null")


_FIELDS = ("instrument_key", "instrumentKey", "segment", "name", "company_name", "companyName", "trading_symbol", "tradingSymbol", "short_name", "shortName", "isin", "tick_size", "tickSize", "lot_size", "lotSize")


def instruments(rows: DataFrame, row: str, segments: tuple[str, ...]) -> DataFrame:
    """Instruments of a provider's rows (JSON objects, whose fields have either of two spellings): those of allowed segments with a key and names; kind and exchange come from the segment.

    Of several names for a field the first counts that is not blank; a lot size that is no positive whole number is 1.
    """
    parsed = F.from_json(row, ", ".join(f"{f} string" for f in _FIELDS), {"mode": "PERMISSIVE"})
    kept = [c for c in rows.columns if c != row]
    text = rows.select(*kept, parsed.alias("_r")).select(*kept, *(F.nullif(F.trim(f"_r.{f}"), F.lit("")).alias(f"_{f}") for f in _FIELDS))
    either = lambda *names: F.coalesce(*(F.col(f"_{n}") for n in names))
    number = lambda *names: F.when((v := either(*names).try_cast("double")) > 0, F.when(v < float("inf"), v))
    out = text.select(
        *kept, either("instrument_key", "instrumentKey").alias("instrument_key"), either("name", "company_name", "companyName", "trading_symbol", "tradingSymbol").alias("name"), either("short_name", "shortName").alias("short_name"),
        either("trading_symbol", "tradingSymbol", "short_name", "shortName", "name").alias("trading_symbol"), F.col("_isin").alias("isin"), number("tick_size", "tickSize").alias("tick_size"), number("lot_size", "lotSize").alias("_lot"), "_segment",
    )
    out = out.withColumn("segment", F.coalesce("_segment", F.when(F.col("instrument_key").contains("|"), F.split_part("instrument_key", F.lit("|"), F.lit(1)))))
    out = out.filter(F.col("instrument_key").isNotNull() & F.col("segment").isin(*segments) & F.col("name").isNotNull() & F.col("trading_symbol").isNotNull())
    lot = F.coalesce(F.when(F.col("_lot") == F.floor("_lot"), F.col("_lot")).cast("long"), F.lit(1).cast("long"))
    kinds = {"exchange": F.split_part("segment", F.lit("_"), F.lit(1)), "kind": F.when(F.col("segment").endswith("INDEX"), "index").otherwise("equity"), "lot_size": lot}
    return out.withColumns(kinds).drop("_lot", "_segment")


def search(found: DataFrame, place: str, exchanges: tuple[str, ...], kinds: tuple[str, ...], limit: int) -> DataFrame:
    """The first instruments of some exchanges and kinds by place, each key once."""
    wanted = found.filter(F.col("exchange").isin(*exchanges) & F.col("kind").isin(*kinds))
    first = wanted.groupBy("instrument_key").agg(F.min(place).alias(place))
    return wanted.join(first, ["instrument_key", place], "left_semi").dropDuplicates(["instrument_key"]).orderBy(place).limit(limit)
