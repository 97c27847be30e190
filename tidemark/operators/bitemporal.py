"""Bitemporal records: what is visible at a market and a knowledge time, and which record of a chain holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(start: Column, end: Column, at: Column) -> Column:
    """start <= at < end; an open end never ends."""
    return (start <= at) & (end.isNull() | (at < end))


def effective(valid_from: Column, valid_until: Column, recorded_at: Column, superseded_at: Column, market_as_of: Column, known_as_of: Column) -> Column:
    return within(valid_from, valid_until, market_as_of) & within(recorded_at, superseded_at, known_as_of)


def violations(records: DataFrame) -> DataFrame:
    """(record_id, violation) of records (record_id, scope_id, recorded_at, supersedes_record_id, and kind if there is one) that break a chain. Strictly increasing times exclude cycles.

    Rows repeated throughout count once; an id of several contents is `conflicting_content`, whatever else it breaks.
    """
    rest = F.struct(*(c for c in ("scope_id", "recorded_at", "supersedes_record_id", "kind") if c in records.columns))
    one = records.groupBy("record_id").agg(F.min(rest).alias("_r"), (~F.min(rest).eqNullSafe(F.max(rest))).alias("_conflict"))
    conflicts = one.filter("_conflict").select("record_id", F.lit("conflicting_content").alias("violation"))
    records = one.filter("not _conflict").select("record_id", "_r.*")
    kind = F.col("kind") if "kind" in records.columns else F.lit("")
    target = one.select(F.col("record_id").alias("supersedes_record_id"), F.col("_r.scope_id").alias("their_scope"), F.col("_r.recorded_at").alias("their_time"), (F.col("_r.kind") if "kind" in records.columns else F.lit("")).alias("their_kind"))
    seen = records.filter("supersedes_record_id is not null").join(target, "supersedes_record_id", "left")
    broken = (
        F.when(F.col("supersedes_record_id") == F.col("record_id"), "self_edge").when(F.col("their_scope").isNull(), "missing_target")
        .when(F.col("their_scope") != F.col("scope_id"), "cross_scope").when(~F.col("their_kind").eqNullSafe(kind), "other_kind").when(F.col("recorded_at") <= F.col("their_time"), "not_later")
    )
    one = seen.select("record_id", broken.alias("violation")).filter("violation is not null")
    twice = records.filter("supersedes_record_id is not null").groupBy("supersedes_record_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return conflicts.unionByName(one).unionByName(twice.select(F.col("supersedes_record_id").alias("record_id"), F.lit("branch").alias("violation")))


def roots(records: DataFrame, depth: int = 20) -> DataFrame:
    """(record_id, root_id) of every record: pointers are doubled until all point at a root, so chains of up to 2**depth records take `depth` joins at most."""
    at = records.select("record_id", F.coalesce("supersedes_record_id", "record_id").alias("root_id"))
    for _ in range(depth):
        far = at.select(F.col("record_id").alias("root_id"), F.col("root_id").alias("far"))
        at = at.join(far, "root_id", "left").select("record_id", F.coalesce("far", "root_id").alias("root_id"), (F.col("far") != F.col("root_id")).alias("moved")).checkpoint()
        done = not at.filter("moved").limit(1).count()
        at = at.drop("moved")
        if done:
            break
    return at


def resolve(records: DataFrame, known_as_of, eligible: Column) -> DataFrame:
    """(scope_id, record_id, state): per scope the last eligible known record of its chain; several chains with one make it ambiguous.

    An eligible record hides its eligible ancestors, ineligible ones in between do not shield them. Chains must pass `violations`.
    """
    known = records.filter(F.col("recorded_at") <= F.lit(known_as_of))
    known = known.join(roots(known), "record_id")
    held = known.filter(eligible).groupBy("scope_id", "root_id").agg(F.max_by("record_id", "recorded_at").alias("record_id"))
    found = held.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("only"))
    return found.select("scope_id", F.when(F.col("n") == 1, F.col("only")).alias("record_id"), F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("state"))


def latest_assessment(assessments: DataFrame, known_as_of, *values: str) -> DataFrame:
    """Per event and policy the last assessment recorded by then."""
    order = F.struct("recorded_at", "assessment_id")
    known = assessments.filter(F.col("recorded_at") <= F.lit(known_as_of))
    return known.groupBy("event_id", "policy_id").agg(F.max_by(F.struct("assessment_id", *values), order).alias("a")).select("event_id", "policy_id", "a.*")


def quote_order(exchange: str, sequence: str, order: str, received: str, available: str, key: str) -> Column:
    """The order of quotes: by exchange time, provider sequence, event order, receipt and availability; unknown places come first."""
    return F.struct(F.col(exchange), F.coalesce(F.col(sequence), F.lit(-1)), F.coalesce(F.col(order), F.lit(-1)), F.coalesce(F.col(received), F.col(available)), F.col(available), F.col(key))


def chain_as_of(quotes: DataFrame, market_as_of, known_as_of) -> DataFrame:
    """Per contract the last visible quote that no visible correction replaces.

    quotes: event_id, contract_id, exchange_timestamp, available_at, recorded_at, provider_sequence, event_order, supersedes_event_id, and values.
    """
    seen = quotes.filter((F.col("exchange_timestamp") <= F.lit(market_as_of)) & (F.col("available_at") <= F.lit(known_as_of)) & (F.col("recorded_at") <= F.lit(known_as_of)))
    replaced = seen.select(F.col("supersedes_event_id").alias("event_id")).dropna()
    held = seen.join(replaced, "event_id", "left_anti")
    order = quote_order("exchange_timestamp", "provider_sequence", "event_order", "recorded_at", "available_at", "event_id")
    columns = [c for c in quotes.columns if c != "contract_id"]
    return held.groupBy("contract_id").agg(F.max_by(F.struct(*columns), order).alias("q")).select("contract_id", "q.*")
