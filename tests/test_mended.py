"""Hard rows of operators over stored records, calendars, conversions, runs and settings."""

import datetime
import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import conversions, digests, options
from tidemark.operators import bitemporal, events, hedging, lookups, risk, stored
from tidemark.plans import market, market_sql
from tidemark.sources import candles, feeds, runs
from tidemark.sources.store import CommitConflict

D = datetime.date
T = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)


def test_numbers_beyond_all_bounds_crash_nothing(session):
    rows = session.createDataFrame([(x,) for x in (1e300, 1e25, 1e20, 1e-19, 0.1, -1.0, float("nan"), float("inf"), 0.0, None)], "x double")
    got = rows.select(conversions.epoch_time(F.col("x")).isNull().alias("late"), conversions.price_decimal(F.col("x")).alias("p"), conversions.price_fault(F.col("x")).alias("f")).collect()
    assert [r["f"] for r in got] == ["out_of_range", "out_of_range", "out_of_range", "out_of_range", None, "negative", "not_finite", "not_finite", None, "not_finite"]
    assert [None if r["p"] is None else float(r["p"]) for r in got] == [None, None, None, None, 0.1, None, None, None, 0.0, None] and [r["late"] for r in got[:3]] == [True] * 3
    body = '{"feeds": {"A": {"ltpc": {"ltp": "1e300", "ltt": "1e300"}}, "B": {"ltpc": {"ltp": 5, "ltt": "1e20", "cp": "1e400"}}, "C": {"ltpc": {"ltp": 5, "ltt": "1704067200"}}}}'
    found = feeds.feed_quotes(session.createDataFrame([(body, T(0))], "payload string, at timestamp"), "payload", "at").collect()
    assert [r["instrument"] for r in found] == ["C"]


def test_times_of_keys_beyond_the_year_9999(session, tmp_path):
    """Keys of larger tables: their moments lie after the year 9999, which the SQL keeps."""
    keys = (0, 3, 2_932_896, 2_932_897, 9_000_001, 53_999_999)
    rows = [(k, "1-URGENT", "F", 10.5) for k in keys]
    session.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = market.provider_conversions(session, str(tmp_path)).orderBy("o_orderkey").collect()
    db = duckdb.connect()
    db.execute(f"create view orders as from '{tmp_path}/orders.parquet/*.parquet'")
    want = db.execute(f"select * from ({market_sql.ORACLE_SQL['provider_conversions']}) order by o_orderkey").fetchall()
    assert [tuple(r) for r in got] == want and got[-1]["expiry"] == "149816-12-24"
    late = session.range(1).select(conversions.epoch_time(F.lit(253_402_300_800_000.0)).alias("x"), F.unix_millis(conversions.epoch_time(F.lit(253_402_300_800_000.0), conversions.LAST_MILLIS)).alias("y")).first()
    assert late["x"] is None and late["y"] == 253_402_300_800_000


def test_candles_of_an_envelope_and_of_a_bare_array(session):
    row = '["2024-01-02T15:00:00+05:30", 1, 2, 0, %s, 9]'
    bodies = [(1, f'{{"status": "success", "data": {{"candles": [{row % 5}]}}}}'), (2, f"[{row % 6}]"), (3, '{"data": {}}'), (4, "{"), (5, None), (6, '{"data": {"candles": []}}')]
    got = candles.closes(session.createDataFrame(bodies, "instrument_id int, payload string")).collect()
    assert {(r["instrument_id"], r["price"]) for r in got} == {(1, 5.0), (2, 6.0)}


def test_calendars(session):
    ranges = session.createDataFrame([(1, D(2024, 1, 5), D(2024, 1, 9)), (2, D(2024, 1, 9), D(2024, 1, 5)), (3, D(2024, 1, 6), D(2024, 1, 6)), (4, None, D(2024, 1, 6))], "k int, first date, last date")
    days = events.sessions(ranges, "first", "last", ["2024-01-08"])
    assert sorted((r["k"], r["session"], r["session_date"]) for r in days.collect()) == [(1, 0, D(2024, 1, 5)), (1, 1, D(2024, 1, 9))]
    out = events.decisions(days, ["09:30", "15:15"], "k", "15:15", "America/New_York", 250).orderBy("step").collect()
    assert [(r["step"], str(r["decision_at"]), r["years"]) for r in out] == [(0, "2024-01-05 20:15:00", 0.0), (1, "2024-01-09 14:30:00", 0.002), (2, "2024-01-09 20:15:00", 0.002)]
    for times, entry in ((["09:30"], "10:00"), (["10:00", "09:30"], "09:30")):
        with pytest.raises(ValueError):
            events.decisions(days, times, "k", entry, "UTC")
    entries = session.createDataFrame([(1, D(2024, 1, 5), 1), (2, D(2024, 1, 6), 1), (3, D(2024, 1, 5), 0), (4, D(2024, 1, 5), 250), (5, None, 3), (6, D(2024, 1, 5), None)], "k int, day date, n int")
    got = {r["k"]: r["expiry_date"] for r in events.expiries(entries, "day", "n", ["2024-01-08"]).collect()}
    assert got == {1: D(2024, 1, 9), 2: D(2024, 1, 10), 3: None, 4: D(2024, 12, 23), 5: None, 6: None}


def _nodes(frame, name):
    return frame._jdf.queryExecution().sparkPlan().toString().count(name)


def test_steps_follow_from_whole_ranges_without_a_window(session):
    ranges = session.createDataFrame([(1, D(2024, 1, 5), D(2024, 1, 16)), (2, D(2024, 1, 6), D(2024, 1, 6)), (3, D(2024, 3, 8), D(2024, 3, 12))], "k int, first date, last date")
    days = events.sessions(ranges, "first", "last", ["2024-01-08"])
    for entry in ("09:30", "10:00", "15:15"):
        got, want = (events.decisions(days, ["09:30", "10:00", "15:15"], by, entry, "America/New_York") for by in (None, "k"))
        assert sorted(got.collect()) == sorted(want.collect()) and (_nodes(got, "Window"), _nodes(want, "Window")) == (0, 1)


def test_marked_states_sort_once_for_the_run_and_once_for_the_session(session):
    rows = [(1, s, c, float(v), 10.0, h) for c, (s, v, h) in enumerate([(0, 11, True), (0, 12, False), (1, 9, True), (0, 8, True), (1, 7, None)])]
    out = risk.marked(session.createDataFrame(rows, "run int, session int, clock int, value double, entry double, hedged boolean"), "run", "session", "clock", "value", "entry", F.col("hedged"))
    got = [tuple(r)[-4:] for r in out.orderBy("clock").collect()]
    assert got == [(1.0, 1.0, 1, 1), (2.0, 2.0, 1, 1), (-1.0, -3.0, 1, 2), (-2.0, -2.0, 2, 3), (-3.0, -5.0, 1, 3)]
    assert _nodes(out, "Window ") == 2


def test_lines_are_dealt_out_by_the_splits_of_their_files(session, tmp_path):
    """What a task sorts stays as large however many files the table has."""
    rows = session.range(0, 400).selectExpr("id div 4 l_orderkey", "id l_partkey", "id l_suppkey", "cast(id % 4 as int) l_linenumber", "1.0D l_extendedprice")
    for files in (1, 12):
        rows.repartition(files).write.option("parquet.block.size", 1024).mode("overwrite").parquet(f"{tmp_path}/{files}/lineitem.parquet")
        read = session.read.parquet(f"{tmp_path}/{files}/lineitem.parquet").rdd.getNumPartitions()
        lines = market._lines(session, f"{tmp_path}/{files}")
        assert lines.rdd.getNumPartitions() == 4 * read and lines.filter("step = l_linenumber + 1").count() == 400


def test_records_of_several_kinds_and_contents(session):
    rows = [(1, "a", "v", T(1), None), (1, "a", "v", T(1), None), (2, "a", "m", T(2), 1), (3, "a", "v", T(3), None), (3, "a", "v", T(4), None), (4, "a", "v", T(5), 2)]
    records = session.createDataFrame(rows, "record_id long, scope_id string, kind string, recorded_at timestamp, supersedes_record_id long")
    assert sorted(tuple(r) for r in bitemporal.violations(records).collect()) == [(2, "other_kind"), (3, "conflicting_content"), (4, "other_kind")]
    assert sorted(tuple(r) for r in bitemporal.violations(records.drop("kind")).collect()) == [(3, "conflicting_content")]


def test_a_mapping_of_another_version_is_no_subject(session):
    mappings = session.createDataFrame([("a", "i", 1, True), ("b", "i", 2, True), ("c", "i", None, True)], "key string, instrument string, version_id int, visible boolean")
    versions = session.createDataFrame([("i", 1, True), ("i", 2, False)], "instrument string, version_id int, visible boolean")
    got = {r["key"]: (r["version_id"], r["reason"]) for r in lookups.subjects(mappings.select("key"), mappings, versions, "key", "instrument").collect()}
    assert got == {"a": (1, None), "b": (None, "mapping_of_other_version"), "c": (1, None)}


def test_hedges_to_a_goal_and_runs_without_fills(session):
    states = session.createDataFrame([(i, d) for i, d in enumerate((-20.0, 3.0, 9.0, 30.0))], "step_index int, net_delta double").selectExpr("*", "100d as spot", "0.1d as gamma", "2d as delta_per_contract")
    got = {(r["policy_id"], r["step_index"]): (r["target_net_delta"], r["contracts"], r["reason"]) for r in hedging.decisions(states, ("fixed_interval", "delta_threshold", "no_hedge"), interval=2, goal=4.0).collect()}
    assert got["fixed_interval", 0] == (4.0, 12, "scheduled_rebalance") and got["fixed_interval", 1] == (4.0, 0, "outside_scheduled_step")
    assert got["delta_threshold", 3] == (4.0, -13, "delta_threshold_breached") and got["delta_threshold", 2] == (4.0, 0, "inside_delta_threshold") and got["no_hedge", 3] == (30.0, 0, "policy_never_hedges")
    fills = session.createDataFrame([("a", "option", "buy", 1, 1)], "run string, kind string, side string, gross int, cost int").selectExpr("run", "kind", "side", "cast(gross as decimal(18,2)) as gross_notional", "cast(cost as decimal(18,2)) as total_cost")
    ends = session.createDataFrame([("a", 5), ("b", 7)], "run string, t int").selectExpr("run", "cast(t as decimal(18,2)) as terminal_pnl")
    assert {r["run"]: (float(r["residual"]), r["reconciled"]) for r in hedging.reconciliation(fills, "run", ends).collect()} == {"a": (7.0, False), "b": (7.0, False)}


def test_option_legs(session):
    rows = [("call", 100.0, 100.0, 1.0, 0.0, 0.0, 0.2, 2, 50), ("put", 100.0, 110.0, 0.0, 0.0, 0.0, 0.2, 1, 50), ("call", 100.0, 90.0, 1.0, 0.0, 0.0, 0.0, 1, 1), ("swap", 100.0, 90.0, 1.0, 0.0, 0.0, 0.2, 1, 1), ("call", None, 90.0, 1.0, 0.0, 0.0, 0.2, 1, 1)]
    legs = session.createDataFrame(rows, "side string, spot double, strike double, years double, rate double, dividend double, volatility double, quantity int, multiplier int")
    got = options.leg_values(legs).collect()
    assert [None if r["market_value"] is None else float(r["market_value"]) for r in got] == [796.56, 500.0, 10.0, None, None]
    assert abs(got[0]["position_delta"] - 53.98278372770290) < 1e-9 and got[1]["position_delta"] == -50.0 and got[2]["position_vega"] == 0.0 and got[3]["price"] is None


def test_a_second_run_of_an_id_writes_nothing(session, tmp_path):
    root = str(tmp_path / "runs")
    runs.write_run(session, root, {"run_id": "r", "created_at": "2025-01-01"}, {"rows": session.range(3)})
    with pytest.raises(CommitConflict):
        runs.write_run(session, root, {"run_id": "r", "created_at": "2025-01-02"}, {"more": session.range(9)})
    assert not (tmp_path / "runs" / "r" / "more").exists() and [r["created_at"] for r in runs.runs(session, root).collect()] == ["2025-01-01"]
    with pytest.raises(Exception, match="own words"):
        runs.write_run(session, root, {"run_id": "s", "created_at": "2025-01-03"}, {"rows": session.range(1).selectExpr("raise_error('own words') as x")})


def test_instruments_of_odd_rows(session):
    rows = ["{}", "[]", "x", None, '{"instrument_key": "A_EQ|1", "name": "n"}', '{"instrument_key": "A_EQ|2", "name": " ", "tradingSymbol": "t", "lot_size": "1e400", "tick_size": -1}', '{"instrumentKey": "B_INDEX|3", "segment": "A_INDEX", "shortName": "s", "name": "n", "lotSize": 2.5}', '{"instrument_key": "C_EQ|4", "name": "n"}']
    frame = session.createDataFrame(list(enumerate(rows)), "place int, row string")
    found = stored.instruments(frame, "row", ("A_EQ", "A_INDEX"))
    assert {(r["place"], r["kind"], r["name"], r["trading_symbol"], r["tick_size"], r["lot_size"]) for r in found.collect()} == {(4, "equity", "n", "n", None, 1), (5, "equity", "t", "t", None, 1), (6, "index", "n", "s", None, 1)}
    assert [r["place"] for r in stored.search(found, "place", ("A",), ("equity", "index"), 2).collect()] == [4, 5]


def test_hashes_of_settings_and_datasets(session):
    sha = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    assert digests.config_hash({"b": D(2024, 1, 1), "a": 0.5}) == sha('{"a":0.5,"b":"2024-01-01"}')
    assert digests.strategy_hash({"x": [1, 1e-7, {"é": 2.50}], "created_at": "now"}) == sha('{"x":[1,"0.0000001",{"é":"2.5"}]}')
    prices = [100.0, 123.456, 1e12, 1234567890123.4, 0.00001234, 1 / 3, 0.0001, 99999999999.97]
    rows = session.createDataFrame([("q\"", D(2024, 1, i + 1), p) for i, p in enumerate(prices)][::-1], "instrument_id string, session_date date, price double")
    want = {"symbol": "q\"", "frequency": "1d_close", "source": "csv", "observations": [{"timestamp": f"2024-01-{i + 1:02}T00:00:00", "price": format(p, ".12g")} for i, p in enumerate(prices)]}
    assert digests.dataset_ids(rows, "csv").first()["dataset_id"] == sha(json.dumps(want, sort_keys=True, separators=(",", ":")))
