"""Faults in the order of connection and subscription events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import canonical

BROKEN, RECONNECT, SUBSCRIPTION = "invalid_connection_lifecycle_sequence", "invalid_connection_reconnect_sequence", "invalid_subscription_lifecycle_sequence"

# The states that may follow each state, "" for none before.
CONNECTION_STEPS = {
    "": ("connecting",), "connecting": ("connected", "failed", "closing"), "connected": ("authorized", "closing", "failed"), "authorized": ("closing", "reconnecting", "failed"),
    "reconnecting": ("closing", "failed"), "closing": ("closed", "failed"), "failed": ("reconnecting", "closing", "closed"),
}
SUBSCRIPTION_STEPS = {
    "": ("subscribe_requested",), "subscribe_requested": ("subscribed", "subscription_failed"), "subscribed": ("mode_change_requested", "unsubscribe_requested", "subscription_failed"),
    "mode_change_requested": ("mode_changed", "subscription_failed"), "mode_changed": ("mode_change_requested", "unsubscribe_requested", "subscription_failed"), "unsubscribe_requested": ("unsubscribed", "subscription_failed"),
}


def allowed(previous: Column, state: Column, steps: dict[str, tuple[str, ...]]) -> Column:
    """Whether a state may follow another."""
    table = F.create_map(*(x for k, v in steps.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.array_contains(F.try_element_at(table, F.coalesce(previous, F.lit(""))), state), F.lit(False))


def observed(raw: DataFrame, kind: str, subject: str) -> DataFrame:
    """Raw events (raw_event_id, previous_state, state, reason_code, and for subscriptions request_mode) of a connection or subscription as observations: their event_id, or the fault of what isn't one.

    Faults: transition, reason_missing (a failure without its code), reason_given (a code without a failure), mode_missing.
    """
    steps = {"connection": CONNECTION_STEPS, "subscription": SUBSCRIPTION_STEPS}[kind]
    failed, state = F.col("state").isin("failed", "subscription_failed"), F.col("state")
    fault = F.when(~allowed(F.col("previous_state"), state, steps), "transition").when(failed & F.col("reason_code").isNull(), "reason_missing").when(~failed & F.col("reason_code").isNotNull(), "reason_given")
    if kind == "subscription":
        fault = fault.when(~state.isin("unsubscribe_requested", "unsubscribed", "subscription_failed") & F.col("request_mode").isNull(), "mode_missing")
    out = raw.withColumn("fault", fault)
    event = canonical.normalized_event_id(F.col("raw_event_id"), F.lit(f"provider_{kind}_lifecycle_observation"), F.col(subject))
    return out.withColumn("event_id", F.when(F.col("fault").isNull(), event))


def _bound_to_one(stream: str, key: str, value: str, clock: str):
    """Whether the value of a key is the one of the key's first event."""
    return F.col(value).eqNullSafe(F.first(value).over(W.partitionBy(stream, key).orderBy(clock)))


def connection_faults(events: DataFrame, stream: str, clock: str) -> DataFrame:
    """Every event that breaks its stream's sequence, with the reason.

    events: session, scope, source_order, previous_state, state, provider. A new session may only follow `reconnecting`, start at `connecting` without a state before it
    and use a session and scope not seen yet; a session keeps one scope and a scope one session, orders rise within a scope, and states chain.
    """
    order = W.partitionBy(stream).orderBy(clock)
    before = lambda name: F.lag(name).over(order)
    scoped = W.partitionBy(stream, "scope").orderBy(clock)
    earlier = scoped.rowsBetween(W.unboundedPreceding, -1)
    session_place = F.row_number().over(W.partitionBy(stream, "session").orderBy(clock))
    scope_place = F.row_number().over(scoped)
    first, moved = before(clock).isNull(), before("session") != F.col("session")
    clean = (before("state") == "reconnecting") & F.col("previous_state").isNull() & (F.col("state") == "connecting") & (session_place == 1) & (scope_place == 1)
    unbound = ~_bound_to_one(stream, "session", "scope", clock) | ~_bound_to_one(stream, "scope", "session", clock)
    falls = F.col("source_order") <= F.max("source_order").over(earlier)
    breaks = ~first & ~moved & ~F.col("previous_state").eqNullSafe(before("state"))
    strange = ~first & (before("provider") != F.col("provider"))
    fault = F.when(~first & moved & ~F.coalesce(clean, F.lit(False)), RECONNECT).when(unbound | falls | breaks | strange, BROKEN)
    return events.withColumn("fault", fault).filter("fault is not null")


def subscription_faults(events: DataFrame, stream: str, clock: str) -> DataFrame:
    """Every event that breaks the sequence of its subscription: it starts with subscribe_requested, keeps provider, session, scope and instruments, and its states chain.

    events: subscription, session, scope, source_order, previous_state, state, provider, instruments, and request_mode if there is
    one: states that answer or end a request keep the mode before, a request to end may leave it out.
    """
    order = W.partitionBy(stream, "subscription").orderBy(clock)
    before = lambda name: F.lag(name).over(order)
    scoped = W.partitionBy(stream, "scope").orderBy(clock).rowsBetween(W.unboundedPreceding, -1)
    falls = F.col("source_order") <= F.max("source_order").over(scoped)
    loose = ~_bound_to_one(stream, "scope", "session", clock) | ~_bound_to_one(stream, "scope", "provider", clock)
    start = before(clock).isNull() & ~(F.col("previous_state").isNull() & (F.col("state") == "subscribe_requested"))
    changed = F.lit(False)
    for name in ("provider", "session", "scope", "instruments"):
        changed = changed | ~F.col(name).eqNullSafe(before(name))
    if "request_mode" in events.columns:
        mode, last = F.col("request_mode"), before("request_mode")
        kept = F.col("state").isin("subscribed", "mode_changed", "subscription_failed", "unsubscribed") & ~mode.eqNullSafe(last)
        changed = changed | kept | ((F.col("state") == "unsubscribe_requested") & F.coalesce(mode != last, F.lit(False)))
    chain = before(clock).isNotNull() & (changed | ~F.col("previous_state").eqNullSafe(before("state")))
    bad = F.coalesce(falls, F.lit(False)) | loose | start | chain
    return events.withColumn("fault", F.when(bad, SUBSCRIPTION)).filter("fault is not null")
