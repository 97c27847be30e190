"""Canonical JSON against a plain reading of its rules, and fixed digests."""

import datetime
import hashlib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical

UTC = datetime.timezone.utc


def plain(v, sets=(), path=""):
    if isinstance(v, dict):
        return {k: plain(x, sets, f"{path}.{k}".strip(".")) for k, x in v.items()}
    if isinstance(v, list):
        out = [plain(x, sets, path + "[]") for x in v]
        return sorted(out, key=text) if path in sets else out
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime.datetime):
        return v.astimezone(UTC).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    d = Decimal(str(v))
    return "0" if d.is_zero() else format(d.normalize(), "f")


def text(v):
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def of(session, values, kind, sets=()):
    rows = session.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["t"] for r in rows.select("i", canonical.payload(rows, "v", sets).alias("t")).orderBy("i").collect()]


def test_numbers(session):
    r = random.Random(5)
    known = [1e20, 1e-7, -0.0, 0.0, 1e23, 2e23, 5e-324, -5e-324, 1.7976931348623157e308, 0.1, -2.5, 1 / 3, 1e16, 123456789.125, 2e-3, 100.0, float("nan"), float("inf"), None]
    drawn = [round(r.uniform(-1, 1) * 10 ** r.randint(-12, 14), 6) for _ in range(2000)] + [r.uniform(-1, 1) for _ in range(2000)]
    got = of(session, known + drawn, "double")
    assert got[16:19] == [None, None, "null"]
    assert [g for g in got if g is not None and g != "null"] == [text(plain(v)) for v in known[:16] + drawn]
    assert of(session, [0, -1, 2**63 - 1, 12300, None], "bigint") == ['"0"', '"-1"', '"9223372036854775807"', '"12300"', "null"]
    assert of(session, [Decimal("120.500"), Decimal("0E-10"), Decimal("1E-10"), Decimal("-5")], "decimal(28,10)") == ['"120.5"', '"0"', '"0.0000000001"', '"-5"']


def test_nested_values_in_any_zone(session):
    value = {
        "b": True, "none": None, "s": 'q"\\\n\x01\x1f\x7fé/', "m": {"z": [1.0], "é": [1.5, None], "a b": []}, "t": datetime.datetime(2024, 1, 2, 3, 4, 5, 678, tzinfo=UTC), "old": datetime.datetime(1960, 12, 31, 23, 59, 59, tzinfo=UTC),
        "d": datetime.date(2024, 2, 3), "legs": [{"x": 1, "A": ["b", 'a"', "a"]}, None], "tags": ["z", "é", "A"], "none_set": None,
    }
    kind = "struct<b: boolean, none: string, s: string, m: map<string, array<double>>, t: timestamp, old: timestamp, d: date, legs: array<struct<x: int, A: array<string>>>, tags: array<string>, none_set: array<int>>"
    sets = {"legs[].A", "tags"}
    zone = session.conf.get("spark.sql.session.timeZone")
    try:
        for session_zone in ("UTC", "America/New_York"):
            session.conf.set("spark.sql.session.timeZone", session_zone)
            rows = session.createDataFrame([(value,)], f"v {kind}")
            (got,) = rows.select(canonical.payload(rows, "v", sets).alias("t")).first()
            assert got == text(plain(value, sets))
    finally:
        session.conf.set("spark.sql.session.timeZone", zone)
    assert of(session, [{"k": float("nan")}, {"k": None}, {}, None], "map<string, double>") == [None, '{"k":null}', "{}", "null"]
    assert of(session, [[float("inf")], [[]] and []], "array<double>") == [None, "[]"]


@pytest.mark.parametrize("kind", ["binary", "timestamp_ntz", "decimal(38,18)", "map<int, string>", "struct<a: array<binary>>", "interval day"])
def test_types_without_a_form_are_refused(session, kind):
    rows = session.sql(f"select cast(null as {kind}) as v") if kind != "interval day" else session.sql("select interval '1' day as v")
    with pytest.raises(TypeError):
        canonical.payload(rows, "v")


def test_identities(session):
    def sha(**fields):
        return "sha256:" + hashlib.sha256(text(plain(fields)).encode()).hexdigest()

    at, lit = datetime.datetime(2024, 1, 1, tzinfo=UTC), F.lit
    null = lit(None).cast("string")
    got = session.range(1).select(
        canonical.raw_frame_id(lit("p"), lit("v3"), lit("c"), lit("s"), lit(7)).alias("frame"),
        canonical.raw_observation_id(lit("p"), null, lit("scope"), lit(3), lit("f"), lit("r"), null).alias("sequence"),
        canonical.raw_observation_id(lit("p"), null, null, lit(None).cast("long"), lit("f"), lit("r"), null).alias("row"),
        canonical.raw_observation_id(lit("p"), null, null, lit(None).cast("long"), null, null, null).alias("nothing"),
        canonical.normalized_event_id(lit("r"), lit("t"), lit("s")).alias("event"),
        canonical.option_id(lit("X"), lit("u"), lit("2024-02-01"), lit("100.50"), lit("call"), lit("european"), lit("cash"), lit(50), lit("INR")).alias("option"),
        canonical.version_id("option_contract_version", lit("o"), lit(at), null, lit(50), lit("0.05"), lit("SYM"), lit("active"), lit("cat")).alias("version"),
        canonical.mapping_id(lit("p"), lit("k"), lit("v"), lit("h"), null, lit(at), null).alias("mapping"),
        canonical.failure_id(lit("res"), lit("subject"), lit("why"), lit("k|1"), null).alias("failure"),
        canonical.source_row_ids(lit("p"), lit("1"), lit("art"), lit(4), lit("h"))[1].alias("occurrence"),
    ).first()
    own = {"scope": "subject", "reason_code": "why", "provider_contract_key": "k|1", "segment": None}
    assert got.asDict() == {
        "frame": sha(entity="raw_market_frame", provider="p", provider_schema_id="v3", connection_session_id="c", source_order_scope_id="s", source_order=7),
        "sequence": sha(entity="raw_market_observation", provider="p", identity_type="provider_sequence", identity_value={"provider_sequence_scope_id": "scope", "provider_sequence": 3}),
        "row": sha(entity="raw_market_observation", provider="p", identity_type="source_row", identity_value={"source_file_id": "f", "source_row_id": "r"}),
        "nothing": None,
        "event": sha(entity="normalized_market_event", raw_event_id="r", event_type="t", subject_id="s", normalization_schema_version=1),
        "option": sha(entity="option_contract", exchange="X", underlying_instrument_id="u", expiry=datetime.date(2024, 2, 1), strike=Decimal("100.5"), option_side="call", exercise_style="european", settlement_type="cash", multiplier=50, currency="INR"),
        "version": sha(entity="option_contract_version", identity_id="o", valid_from=at, valid_until=None, lot_size=50, tick_size=Decimal("0.05"), display_symbol="SYM", trading_status="active", catalogue_version_id="cat"),
        "mapping": sha(entity="provider_contract_mapping", provider="p", provider_contract_key="k", contract_version_id="v", provider_payload_hash="h", source_row_identity=None, effective_from=at, effective_until=None),
        "failure": sha(entity="market_normalization_failure", result_id="res", payload=text(own), **own),
        "occurrence": sha(entity="catalogue_source_row_occurrence", source_artifact_id="art", physical_row_number=4, raw_row_hash="h"),
    }
    # a fixed digest, so that no change of both sides goes unseen
    assert sha(entity="raw_market_frame", source_order=0) == "sha256:" + hashlib.sha256(b'{"entity":"raw_market_frame","source_order":"0"}').hexdigest()
