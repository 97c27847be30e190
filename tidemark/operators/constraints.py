"""Rules of stored rows, evaluated all at once: each row with the names of the rules that it breaks, in the rules' order.

A rule is a name and the condition that breaks it; a condition that is null doesn't. Rows are judged in one pass, so that
accepted and rejected ones are two filters of one result and nothing is read twice.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import conversions
from tidemark.operators import frames as fr

Rule = tuple[str, Column]
IDENTIFIER_BYTES = 512
# The versions and semantics that stored rows state.
SCHEMA_VERSION = 1
SEMANTICS = {"presence_semantics": "proto3_parent_implied_v1", "numeric_basis": "protobuf_double_roundtrip_decimal_v1"}
MODES_OF = {"ltpc": ("ltpc",), "indexFF": ("full_d5", "full_d30"), "marketFF": ("full_d5", "full_d30"), "firstLevelWithGreeks": ("option_greeks",)}
KINDS_OF = {"ltpc": ("underlying", "future", "option"), "indexFF": ("underlying",), "marketFF": ("future", "option"), "firstLevelWithGreeks": ("option",)}


def judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows with `broken` (array of names) and `accepted`."""
    names = F.array(*(F.when(condition, F.lit(name)) for name, condition in rules))
    return rows.withColumn("broken", F.filter(names, lambda n: n.isNotNull())).withColumn("accepted", F.size("broken") == 0)


def _any(conditions) -> Column:
    """One condition that null leaves false."""
    return reduce(or_, (F.coalesce(c, F.lit(False)) for c in conditions))


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name)) == "")


def _opaque(name: str) -> Column:
    return _blank(name) | (F.octet_length(name) > IDENTIFIER_BYTES)


def _ordinal(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) < 0)


def _differ(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def _between(name: str, low: int, high: int, null: bool) -> Column:
    outside = (F.col(name) < low) | (F.col(name) > high)
    return F.coalesce(outside, F.lit(not null))


def _of(table: dict[str, tuple[str, ...]], key: str, value: str) -> Column:
    """Whether a value isn't one of those of a key."""
    return ~F.coalesce(_any(((F.col(key) == k) & F.col(value).isin(*v)) for k, v in table.items()), F.lit(False))


def _paths(name: str) -> Column:
    own = F.coalesce(F.col(name), F.array().cast("array<string>"))
    return (F.array_sort(F.array_distinct(own)) != own) | F.exists(own, lambda p: F.coalesce(~p.rlike(r"^[A-Za-z0-9_.\[\]:*]+$"), F.lit(True)))


def clock_rules() -> list[Rule]:
    """received_at (may be null), available_at, recorded_at, availability_basis (received, historical_import)."""
    received, available, basis = F.col("received_at"), F.col("available_at"), F.col("availability_basis")
    return [
        ("clock_missing", available.isNull() | F.col("recorded_at").isNull()),
        ("recorded_before_available", F.col("recorded_at") < available),
        ("available_before_received", available < received),
        ("basis_unknown", ~F.coalesce(basis.isin("received", "historical_import"), F.lit(False))),
        ("receipt_missing", (basis == "received") & received.isNull()),
        ("receipt_differs", (basis == "received") & (available != received)),
        ("receipt_of_import", (basis == "historical_import") & received.isNotNull()),
    ]


def quote_rules() -> list[Rule]:
    """Rules of quote rows; the subject's own columns are named subject_*, the identity's identity_*."""
    union, mode, levels, normal = F.col("feed_union"), F.col("request_mode"), F.col("levels"), F.col("normalized_levels")
    prices, sizes = ("bid_price", "ask_price", "last_price", "previous_close"), ("bid_size", "ask_size", "last_size", "volume")
    most = F.when(mode == "full_d5", fr.FEW_LEVELS).otherwise(fr.MOST_LEVELS)
    depth = F.when(union.isin("ltpc", "indexFF"), (levels != 0) | (normal != 0)).when(union == "firstLevelWithGreeks", ~levels.isin(0, 1) | (normal != levels)).otherwise((levels > most) | (normal != F.least(levels, F.lit(1))))
    texts = ("raw_event_id", "provider", "provider_key", "mapping_id", "version_id", "subject_id", "scope_id")
    return [
        ("identity_differs", _differ("identity_raw_event_id", "raw_event_id") | _differ("identity_subject_id", "subject_id")),
        ("text_missing", _any(map(_blank, texts))),
        ("provider_differs", _differ("provider", "subject_provider")),
        ("provider_key_differs", _differ("provider_key", "subject_provider_key")),
        ("mapping_differs", _differ("mapping_id", "subject_mapping_id")),
        ("version_differs", _differ("version_id", "subject_version_id")),
        ("subject_differs", _differ("subject_id", "subject_subject_id")),
        ("event_type_differs", _of({k: (v,) for k, v in fr.KINDS.items()}, "kind", "event_type")),
        ("response_type", ~F.coalesce(F.col("response_type").isin("initial_feed", "live_feed"), F.lit(False))),
        ("mode_of_union", _of(MODES_OF, "feed_union", "request_mode")),
        ("kind_of_union", _of(KINDS_OF, "feed_union", "kind")),
        ("snapshot_differs", ~F.col("is_snapshot").eqNullSafe(F.col("response_type") == "initial_feed")),
        ("scope_too_long", _opaque("scope_id") & ~_blank("scope_id")),
        ("source_order", _ordinal("source_order")),
        ("sequence_given", F.col("provider_sequence").isNotNull() | F.col("supersedes_event_id").isNotNull()),
        ("schema_version", ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)) | _differ("identity_schema_version", "schema_version")),
        *((name, ~F.col(name).eqNullSafe(F.lit(value))) for name, value in SEMANTICS.items()),
        ("price", _any(F.isnan(p) | (F.abs(F.col(p)) == float("inf")) | (F.col(p) < 0) for p in prices)),
        ("quantity", _any(F.col(s) < 0 for s in sizes)),
        ("open_interest", _between("open_interest", 0, fr.SAFE, True)),
        ("levels", _between("levels", 0, fr.MOST_LEVELS, False)),
        ("normalized_levels", _between("normalized_levels", 0, 1, False)),
        ("unadopted_levels", F.coalesce(F.col("unadopted_levels") < 0, F.lit(True))),
        ("levels_differ", ~F.col("unadopted_levels").eqNullSafe(levels - normal)),
        ("levels_of_union", depth),
        *((name, _paths(name)) for name in ("unadopted_paths", "present_paths", "secondary_paths")),
        *clock_rules(),
    ]


def status_rules() -> list[Rule]:
    """Rules of segment-state rows."""
    known = fr.name_of(F.col("status_number"), fr.STATES)
    return [
        ("identity_differs", _differ("identity_raw_event_id", "raw_event_id") | (F.col("event_type") != "market_segment_status_observation")),
        ("text_missing", _any(map(_blank, ("provider", "segment", "status", "scope_id")))),
        ("segment", conversions.identifier_fault(F.col("segment"), fr.SEGMENT_BYTES).isNotNull()),
        ("source_order", _ordinal("source_order")),
        ("status_number", F.col("status_number").isNull()),
        ("status_differs", ~F.col("status").eqNullSafe(F.coalesce(known, F.lit("UNKNOWN"))) | ~F.col("known").eqNullSafe(known.isNotNull())),
        ("recorded_before_available", F.col("recorded_at") < F.col("available_at")),
        ("available_before_received", F.col("available_at") < F.col("received_at")),
    ]


def raw_frame_rules(most_bytes: int = 16 << 20) -> list[Rule]:
    """Rules of raw frames: frame (binary), content_hash (sha256:...), three clocks, capture_basis, file and record."""
    received, available, basis = F.col("received_at"), F.col("available_at"), F.col("capture_basis")
    size = F.coalesce(F.octet_length("frame"), F.lit(0))
    return [
        *((f"{n}_identifier", _opaque(n)) for n in ("schema_id", "session_id", "scope_id")),
        ("source_order", _ordinal("source_order")),
        ("frame_empty", size == 0),
        ("frame_too_large", size > most_bytes),
        ("content_differs", ~F.col("content_hash").eqNullSafe(F.concat(F.lit("sha256:"), F.sha2("frame", 256)))),
        ("recorded_before_available", F.col("recorded_at") < available),
        ("available_before_received", available < received),
        ("basis_unknown", ~F.coalesce(basis.isin("live_received", "recorded_with_original_receipt", "historical_import"), F.lit(False))),
        ("receipt_differs", basis.isin("live_received", "recorded_with_original_receipt") & ~received.eqNullSafe(available)),
        ("receipt_of_import", (basis == "historical_import") & received.isNotNull()),
        ("file_without_record", F.col("source_file_id").isNull() != F.col("source_record_id").isNull()),
    ]


def subject_rules() -> list[Rule]:
    """Rules of resolved subjects: what their mapping (mapping_*) and version (version_*) say, and that both hold at both cutoffs."""

    def holds(prefix: str) -> Column:
        at = lambda start, end, moment: (F.col(f"{prefix}_{start}") <= F.col(moment)) & (F.col(f"{prefix}_{end}").isNull() | (F.col(moment) < F.col(f"{prefix}_{end}")))
        return F.coalesce(at("valid_from", "valid_until", "market_as_of") & at("recorded_at", "superseded_at", "known_as_of"), F.lit(False))

    return [
        ("text_missing", _any(map(_blank, ("provider", "provider_key", "mapping_id", "version_id", "subject_id")))),
        ("provider_key", conversions.identifier_fault(F.col("provider_key"), fr.KEY_BYTES).isNotNull()),
        ("kind_unknown", ~F.coalesce(F.col("kind").isin(*fr.KINDS), F.lit(False))),
        ("version_of_other_subject", _differ("version_subject_id", "subject_id")),
        ("mapping_of_other_provider", _differ("mapping_provider", "provider")),
        ("mapping_of_other_key", _differ("mapping_provider_key", "provider_key")),
        ("mapping_of_other_version", _differ("mapping_version_id", "version_id")),
        ("stale_provider_mapping", ~holds("mapping")),
        ("stale_contract_version", ~holds("version")),
    ]
