"""Provider frames: decoding against an independent reading of the format, and the reasons of broken frames and entries."""

import datetime
import hashlib
import random

import pyarrow as pa
import pytest

from tidemark.operators import constraints
from tidemark.operators import frames as fr
from tidemark.sources import wire


def read(raw):
    return wire.responses(pa.array(raw, pa.binary())).to_pylist()


def some(r, name):
    """A random message of a kind."""
    out, chosen = {}, {}
    for f in wire.MESSAGES[name]:
        if f.union:
            chosen.setdefault(f.union, r.choice([g.name for g in wire.MESSAGES[name] if g.union == f.union] + [None]))
        if f.kind == "double":
            out[f.name] = r.choice([0.0, 1.5, -2.25, float("inf"), r.random()])
        elif f.kind in ("long", "enum"):
            out[f.name] = r.choice([0, 1, -1, r.randrange(2**31), (2**62 if f.kind == "long" else 7)])
        elif f.kind == "string":
            out[f.name] = r.choice(["", "I1", "é中"])
        elif f.kind == "message":
            out[f.name] = some(r, f.of) if (chosen[f.union] == f.name if f.union else r.random() < 0.6) else None
        elif f.kind == "messages":
            out[f.name] = [some(r, f.of) for _ in range(r.randrange(4))]
        else:
            keys = sorted({f"S|{r.randrange(30)}" for _ in range(r.randrange(5))})
            out[f.name] = [{"key": k, "value": r.randrange(9) if f.of == "enum" else some(r, f.of)} for k in keys]
    return out


def test_written_frames_decode_to_their_values():
    r = random.Random(1)
    values = [some(r, "Response") for _ in range(300)]
    raw = [wire.written(v) for v in values]
    assert read(raw) == [v if b else None for v, b in zip(values, raw)]
    # what no message knows is passed over: numbers, both fixed sizes, texts, nested groups
    unknown = b"\x78\x05" + b"\x81\x01" + b"8bytes.." + b"\x85\x01abcd" + b"\x8a\x01\x02xy" + b"\x93\x01\x08\x01\x9b\x01\x9c\x01\x94\x01"
    assert read([b + unknown for b in raw if b]) == [v for v, b in zip(values, raw) if b]
    assert read([b[:-1] for b in raw if b]) == [None] * sum(map(bool, raw))


@pytest.mark.parametrize("raw", [None, b"", b"\x80", b"\x00\x01", b"\x0b", b"\x0c", b"\x0b\x14", b"\x0f", b"\x08" + b"\xff" * 10 + b"\x01", b"\x12\x7f", b"\x12\x03\x0a\x01\xff", b"\x12\x04\x12\x02\x0a\x09"])
def test_broken_frames(raw):
    assert read([raw, b"\x18\x01"]) == [None, {"type": 0, "feeds": [], "current_ts": 1, "info": None}]


def test_merging_and_last_values():
    feed = lambda *parts: wire.responses(pa.array([b"".join(wire.written(p, "Feed") for p in parts)], pa.binary()), "Feed").to_pylist()[0]
    assert feed({"ltpc": {"ltp": 1.0}}, {"ltpc": {"ltq": 2}})["ltpc"] == {"ltp": 1.0, "ltt": 0, "ltq": 2, "cp": 0.0}
    last = feed({"ltpc": {"ltp": 1.0}}, {"first": {"vtt": 3}}, {"ltpc": {"ltq": 2}})
    assert last["first"] is None and last["ltpc"] == {"ltp": 0.0, "ltt": 0, "ltq": 2, "cp": 0.0}
    one, two = (wire.written({"feeds": [{"key": "k", "value": {"mode": m}}], "type": m}) for m in (1, 2))
    assert read([one + two])[0] == {"type": 2, "feeds": [{"key": "k", "value": {"ltpc": None, "full": None, "first": None, "mode": 2}}], "current_ts": 0, "info": None}
    assert read([b"\x12\x03\x0a\x01k"])[0]["feeds"] == [{"key": "k", "value": {"ltpc": None, "full": None, "first": None, "mode": 0}}]
    assert read([b"\x08\x01\x0d\x01\x02\x03\x04"])[0]["type"] == 1  # a known number of another wire type


def test_reasons_of_frames(session):
    feeds = [{"key": "S|1", "value": {}}]
    info = lambda *keys: {"segments": [{"key": k, "value": 9} for k in keys]}
    cases = [
        (None, "protobuf_decode_failed"), ({"type": 7, "current_ts": 1, "feeds": feeds}, "unsupported_response_type"), ({"feeds": feeds}, "missing_provider_timestamp"), ({"feeds": feeds, "current_ts": -1}, "invalid_provider_timestamp"),
        ({"feeds": feeds, "current_ts": 253_402_300_800_000}, "invalid_provider_timestamp"), ({"feeds": feeds, "current_ts": 253_402_300_799_999}, None), ({"current_ts": 1}, "empty_primary_payload"), ({"current_ts": 1, "type": 2, "feeds": feeds}, "empty_primary_payload"),
        ({"current_ts": 1, "type": 2, "info": info("x ")}, "invalid_market_segment"), ({"current_ts": 1, "type": 2, "info": info(" x")}, "invalid_market_segment"), ({"current_ts": 1, "type": 2, "info": info("x" * 129)}, "invalid_market_segment"), ({"current_ts": 1, "type": 2, "info": info("x" * 128)}, None),
        ({"current_ts": 1, "feeds": [{"key": "", "value": {}}]}, "invalid_provider_contract_key"), ({"current_ts": 1, "feeds": [{"key": "é" * 257, "value": {}}]}, "invalid_provider_contract_key"),
        ({"current_ts": 1, "feeds": [{"key": f"S|{i:05}", "value": {}} for i in range(5001)]}, "too_many_feeds"), ({"current_ts": 1, "type": 2, "info": info(*(f"s{i:03}" for i in range(257)))}, "too_many_status_segments"),
    ]
    rows = session.createDataFrame([(i, None if v is None else wire.written(v), "kept") for i, (v, _) in enumerate(cases)], "n int, frame binary, response_type_of string")
    judged = fr.judged(wire.decoded(rows, "frame"))
    assert {r["n"]: r["fault"] for r in judged.collect()} == {i: reason for i, (_, reason) in enumerate(cases)}
    states = {(r["n"], r["status"], r["known"], r["status_number"]) for r in fr.segment_states(judged).collect()}
    assert states == {(11, "UNKNOWN", False, 9)}
    assert fr.judged(wire.decoded(rows.limit(0), "frame")).count() == 0


def test_quotes_keep_null_times_levels_and_unknown_keys(session):
    market = {"ltpc": {"ltp": -0.0, "ltq": 1}, "levels": {"quotes": [{"bid_p": 1.0}] * 31}}
    entries = {
        "a": {"full": {"market": {**market, "levels": {"quotes": [{"bid_p": 1.0, "ask_q": 4}] * 5}}}, "mode": 1}, "b": {"full": {"market": market}, "mode": 3}, "c": {"full": {"market": {**market, "levels": {"quotes": [{}] * 6}}}, "mode": 1},
        "d": {"full": {}, "mode": 1}, "e": {"mode": 0}, "f": {"ltpc": {}, "mode": 9}, "g": {"ltpc": {"ltt": 2**62}, "mode": 0}, "h": {"first": {"ltpc": {}, "oi": float("nan")}, "mode": 2}, "i": {"ltpc": {}, "mode": 0},
    }
    frame = wire.written({"type": 1, "current_ts": 1500, "feeds": [{"key": k, "value": v} for k, v in entries.items()]})
    rows = session.createDataFrame([(1, frame)], "n int, frame binary")
    subjects = session.createDataFrame([(k, f"s{k}", "option", None) for k in entries if k != "i"], "provider_key string, subject_id string, kind string, subject_fault string")
    got = {r["provider_key"]: r for r in fr.quotes(fr.judged(wire.decoded(rows, "frame")), subjects).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "a": None, "b": "depth_limit_exceeded", "c": "request_mode_depth_mismatch", "d": "unsupported_feed_union", "e": "unsupported_feed_union", "f": "request_mode_union_mismatch", "g": "invalid_timestamp", "h": "unsafe_open_interest", "i": "unknown_provider_key",
    }
    a = got["a"]
    assert (a["bid_price"], a["ask_size"], a["last_trade_at"], a["levels"], a["normalized_levels"], a["unadopted_levels"], str(a["last_price"])) == (1.0, 4, None, 5, 1, 4, "0.0")
    assert a["provider_at"] == datetime.datetime(1970, 1, 1, 0, 0, 1, 500000) and got["i"]["subject_id"] is None


def test_rules_of_statuses_frames_and_subjects(session):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)

    def broken(rules, good, *changes):
        schema = ", ".join(f"{k} {'timestamp' if k.endswith(('_at', '_of', '_from', '_until')) else {bytes: 'binary', int: 'bigint', bool: 'boolean'}.get(type(v), 'string')}" for k, v in good.items())
        rows = session.createDataFrame([tuple({**good, **c}.values()) for c in ({}, *changes)], schema)
        return [",".join(r["broken"]) for r in constraints.judged(rows, rules).collect()]

    status = {"identity_raw_event_id": "r", "raw_event_id": "r", "event_type": "market_segment_status_observation", "provider": "p", "segment": "A", "status": "NORMAL_OPEN", "scope_id": "s", "source_order": 0, "status_number": 2, "known": True, "recorded_at": at(3), "available_at": at(2), "received_at": at(1)}
    changes = ({"raw_event_id": "x"}, {"segment": " A"}, {"source_order": -1}, {"status_number": 9}, {"status_number": 9, "status": "UNKNOWN", "known": False}, {"recorded_at": at(0)}, {"received_at": None}, {"status": None})
    assert broken(constraints.status_rules(), status, *changes) == ["", "identity_differs", "segment", "source_order", "status_differs", "", "recorded_before_available", "", "text_missing,status_differs"]
    frame = {"schema_id": "v3", "session_id": "c", "scope_id": "s", "source_order": 1, "frame": b"abc", "content_hash": "sha256:" + hashlib.sha256(b"abc").hexdigest(), "received_at": at(2), "available_at": at(2), "recorded_at": at(3), "capture_basis": "live_received", "source_file_id": None, "source_record_id": None}
    changes = ({"frame": b""}, {"content_hash": "sha256:0"}, {"received_at": at(1)}, {"capture_basis": "historical_import"}, {"capture_basis": "historical_import", "received_at": None}, {"source_file_id": "f"}, {"session_id": "é" * 300}, {"frame": None})
    want = ["", "frame_empty,content_differs", "content_differs", "receipt_differs", "receipt_of_import", "", "file_without_record", "session_id_identifier", "frame_empty,content_differs"]
    assert broken(constraints.raw_frame_rules(), frame, *changes) == want
    subject = {"provider": "p", "provider_key": "k", "mapping_id": "m", "version_id": "v", "subject_id": "s", "kind": "option", "version_subject_id": "s", "mapping_provider": "p", "mapping_provider_key": "k", "mapping_version_id": "v", "market_as_of": at(5), "known_as_of": at(5)}
    subject |= {f"{p}_{n}": v for p in ("mapping", "version") for n, v in (("valid_from", at(1)), ("valid_until", None), ("recorded_at", at(1)), ("superseded_at", at(9)))}
    changes = ({"mapping_version_id": "w"}, {"version_valid_until": at(5)}, {"mapping_superseded_at": at(5)}, {"kind": "bond"}, {"version_valid_from": None}, {"provider_key": "k\x01"})
    assert broken(constraints.subject_rules(), subject, *changes) == ["", "mapping_of_other_version", "stale_contract_version", "stale_provider_mapping", "kind_unknown", "stale_contract_version", "provider_key,mapping_of_other_key"]


def test_columns_of_messages_are_written_as_one_by_one():
    rng = random.Random(3)

    def value(message, depth=0):
        out = {}
        for f in wire.MESSAGES[message]:
            one = {
                "double": lambda: rng.choice([0.0, -0.0, 1.5, float("nan"), float("-inf")]), "long": lambda: rng.choice([0, 1, 127, 128, -1, 2**62, -(2**63)]), "enum": lambda: rng.choice([0, 2, 300, -5]), "string": lambda: rng.choice(["", "é|x", "k" * 200]),
                "message": lambda: value(f.of, depth + 1), "messages": lambda: [value(f.of, depth + 1) for _ in range(rng.randrange(4))], "map": lambda: [value(f"{f.of}Entry", depth + 1) for _ in range(rng.randrange(4))],
            }[f.kind]
            out[f.name] = None if rng.random() < 0.2 else one()
        return out

    rows = [None if i % 11 == 5 else value("Response") for i in range(60)]
    column = pa.array(rows, wire.arrow_type("Response"))
    for part, wanted in ((column, rows), (column[7:31], rows[7:31]), (column[:0], [])):
        data, size = wire.written_all(part)
        want = [b"" if r is None else wire.written(r) for r in wanted]
        assert size.tolist() == [len(w) for w in want] and data.tobytes() == b"".join(want)


def test_frames_of_many_rows_keep_their_keys_and_nulls(session):
    kind = f"k long, v {wire.ddl(wire.arrow_type('Response'))}"
    rows = [(i, None if i % 7 == 3 else {"type": i % 3, "feeds": [], "current_ts": i, "info": None}) for i in range(50)]
    got = wire.encoded(session.createDataFrame(rows, kind), "v").collect()
    assert {r["k"]: None if r["frame"] is None else bytes(r["frame"]) for r in got} == {k: None if v is None else wire.written(v) for k, v in rows}


def test_results_exchange_no_whole_frames(session):
    frames = session.createDataFrame([(1, None)], f"frame_id long, response {wire.ddl(wire.arrow_type('Response'))}")
    subjects = session.createDataFrame([], "provider_key string, subject_id string, kind string, subject_fault string")
    judged = fr.judged(frames)
    out = fr.results(judged, "frame_id", fr.quotes(judged, subjects))
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    kinds = [node.output().apply(i).dataType().catalogString() for i in range(node.output().size())]
    assert kinds and not any("ltpc" in k for k in kinds)
    assert [(r["fault"], r["status"]) for r in out.collect()] == [("protobuf_decode_failed", "failed")]
