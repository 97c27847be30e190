"""Option chains as of a market and a knowledge time: which quotes are visible, which corrections hold, and the last quote of each contract.

quotes: event_id, contract_id, event_type, version_id, mapping_id, exchange_timestamp, received_at, available_at,
availability_basis, provider_sequence, event_order, supersedes_event_id, and values. versions: version_id, contract_id, and
mappings: mapping_id, version_id, each with valid_from, valid_until, recorded_at, superseded_at. assessments: event_id,
policy_id, policy_version, assessment_id, recorded_at, disposition. Exact repetitions of a row count once; rows that share
an id and differ are conflicts, and so are ids in all that refers to them.

Joins are by ids, each of one exchange; nothing is compared with all of anything. Corrections fail closed: a contract with
one that doesn't hold has no answer, only its fault.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bitemporal import quote_order, within
from tidemark.workers import kept

# Bases of availability whose knowledge time can be defended, and dispositions that admit a quote.
DEFENSIBLE, ADMITTED = ("received", "provider_disseminated"), ("accepted", "accepted_with_flags")


@dataclass(frozen=True)
class Cutoff:
    """A null known_as_of asks for the market's view, without a knowledge time."""

    market_as_of: datetime.datetime
    known_as_of: datetime.datetime | None
    policy_id: str
    policy_version: int
    defensible: bool = True


def single(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, with `conflict` where rows of the key differ."""
    rest = F.struct(*(F.col(c) for c in rows.columns if c != key))
    one = rows.groupBy(key).agg(F.min(rest).alias("_r"), (~F.min(rest).eqNullSafe(F.max(rest))).alias("conflict"))
    return one.select(key, "_r.*", "conflict")


def _effective(prefix: str, market: Column, known: Column | None) -> Column:
    at = lambda name: F.col(f"_{prefix}_{name}")
    held = within(at("valid_from"), at("valid_until"), market)
    return held if known is None else held & within(at("recorded_at"), at("superseded_at"), known)


def eligibility(quotes: DataFrame, versions: DataFrame, mappings: DataFrame, assessments: DataFrame, cutoff: Cutoff) -> DataFrame:
    """The quotes (each once) with `reason` why one isn't visible at the cutoff, or null, and `eligible`: whether it was good at its own times, as targets of corrections must be."""

    def side(frame: DataFrame, key: str, prefix: str) -> DataFrame:
        return single(frame, key).select(F.col(key), *(F.col(c).alias(f"_{prefix}_{c}") for c in [*(c for c in frame.columns if c != key), "conflict"]), F.lit(True).alias(f"_{prefix}"))

    known = None if cutoff.known_as_of is None else F.lit(cutoff.known_as_of)
    seen = assessments.filter((F.col("policy_id") == cutoff.policy_id) & (F.col("policy_version") == cutoff.policy_version))
    seen = seen if known is None else seen.filter(F.col("recorded_at") <= known)
    last = seen.groupBy("event_id").agg(F.max_by("disposition", F.struct("recorded_at", "assessment_id")).alias("_disposition"))
    q = single(quotes, "event_id").join(side(versions, "version_id", "v"), "version_id", "left").join(side(mappings, "mapping_id", "m"), "mapping_id", "left").join(last, "event_id", "left")
    market, exchange, available = F.lit(cutoff.market_as_of), F.col("exchange_timestamp"), F.col("available_at")
    refers = (
        F.when(F.col("conflict") | F.col("_v_conflict") | F.col("_m_conflict"), "conflicting_identity").when(F.col("_v").isNull(), "missing_version").when(F.col("_m").isNull(), "missing_mapping")
        .when(~F.col("_v_contract_id").eqNullSafe(F.col("contract_id")), "version_of_other_contract").when(~F.col("_m_version_id").eqNullSafe(F.col("version_id")), "mapping_of_other_version")
    )
    late = F.when(exchange > market, "after_market_cutoff")
    if known is not None:
        late = late.when(available > known, "after_knowledge_cutoff")
        if cutoff.defensible:
            late = late.when(~F.coalesce(F.col("availability_basis").isin(*DEFENSIBLE), F.lit(False)), "indefensible_availability")
    ineffective = F.when(~F.coalesce(_effective("v", market, known), F.lit(False)), "stale_version").when(~F.coalesce(_effective("m", market, known), F.lit(False)), "stale_mapping")
    judged = F.when(F.col("_disposition").isNull(), "not_assessed").when(~F.col("_disposition").isin(*ADMITTED), "not_admitted")
    own = F.coalesce(_effective("v", exchange, available) & _effective("m", exchange, available), F.lit(False))
    return q.select(*quotes.columns, F.coalesce(refers, ineffective, late, judged).alias("reason"), (refers.isNull() & late.isNull() & own).alias("eligible"), F.col("conflict"))


def cycles(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(source) of the edges on cycles, where every source has one edge.

    On a cycle every source is a target and every target a source; what is left after that test, usually nothing, is
    followed by doubling: after as many rounds as the edges have binary digits only cycles still lead on.
    """
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t"))
    e = kept(e.join(edges.select(F.col(target).alias("s")), "s", "left_semi").join(edges.select(F.col(source).alias("t")), "t", "left_semi").select("s", "t"))
    for _ in range(int(e.count()).bit_length()):
        e = kept(e.join(e.select(F.col("s").alias("t"), F.col("t").alias("far")), "t").select("s", F.col("far").alias("t")))
    return e.select(F.col("s").alias(source))


def correction_faults(judged: DataFrame) -> DataFrame:
    """(event_id, contract_id, fault) of the visible corrections of `eligibility` that don't hold, one fault each."""
    corrections = judged.filter("reason is null and supersedes_event_id is not null").select("event_id", "contract_id", "event_type", "supersedes_event_id")
    target = judged.select(F.col("event_id").alias("supersedes_event_id"), F.col("contract_id").alias("_contract"), F.col("event_type").alias("_type"), F.col("eligible").alias("_eligible"))
    seen = corrections.join(target, "supersedes_event_id", "left")
    fault = (
        F.when(F.col("event_id") == F.col("supersedes_event_id"), "self").when(~F.coalesce("_eligible", F.lit(False)), "no_eligible_target")
        .when(~F.col("_contract").eqNullSafe(F.col("contract_id")), "other_contract").when(~F.col("_type").eqNullSafe(F.col("event_type")), "other_type")
    )
    seen = kept(seen.select("event_id", "contract_id", "supersedes_event_id", fault.alias("fault")))  # corrections only, and used several times
    sound = seen.filter("fault is null")
    branches = sound.groupBy("supersedes_event_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    branched = sound.join(branches, "supersedes_event_id", "left_semi").select("event_id", "contract_id", F.lit("branch").alias("fault"))
    straight = sound.join(branches, "supersedes_event_id", "left_anti")
    cycled = straight.join(cycles(straight, "event_id", "supersedes_event_id"), "event_id", "left_semi").select("event_id", "contract_id", F.lit("cycle").alias("fault"))
    return seen.filter("fault is not null").select("event_id", "contract_id", "fault").unionByName(branched).unionByName(cycled)


def chain(judged: DataFrame, faults: DataFrame, *values: str) -> DataFrame:
    """Per contract with a visible quote the last one that no visible correction replaces, or, where a correction doesn't hold, the contract's least fault and no quote."""
    visible = judged.filter("reason is null")
    held = visible.join(visible.select(F.col("supersedes_event_id").alias("event_id")).dropna(), "event_id", "left_anti")
    order = quote_order("exchange_timestamp", "provider_sequence", "event_order", "received_at", "available_at", "event_id")
    last = held.groupBy("contract_id").agg(F.max_by(F.struct("event_id", "exchange_timestamp", *values), order).alias("_q"))
    refused = faults.groupBy("contract_id").agg(F.min("fault").alias("fault"))
    out = last.join(refused, "contract_id", "full")
    good = F.col("fault").isNull()
    return out.select("contract_id", "fault", *(F.when(good, F.col(f"_q.{c}")).alias(c) for c in ("event_id", "exchange_timestamp", *values)))
