import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tidemark.operators import volatility  # noqa: E402
from tidemark.sources import feeds, files, runs  # noqa: E402
from tidemark.streaming import quotes as streams  # noqa: E402

END = datetime.date(2025, 3, 7)


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _csv(folder, n, header="Date ,CLOSE"):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(i) for i in range(n)]
    lines = [header, *[f"{d},{i + 1}" for i, d in enumerate(days)], f"{days[0]},77", f"{days[1]},-5", "never,3", f"{days[2]},x"]
    path = folder / "prices.csv"
    path.write_text("\n".join(lines))
    return str(path)


def test_csv_prices_take_the_last_valid_line_of_a_day(spark, tmp_path):
    got = {r["session_date"].date(): r["price"] for r in files.csv_prices(spark, _csv(tmp_path, 120)).collect()}
    assert len(got) == 120 and got[datetime.date(2024, 1, 1)] == 77 and got[datetime.date(2024, 1, 2)] == 2 and got[datetime.date(2024, 1, 3)] == 3


def test_short_or_nameless_files_fall_back_to_a_seeded_series(spark, tmp_path):
    (tmp_path / "a").mkdir()
    frame, source = files.price_dataset(spark, _csv(tmp_path, 50), 300, 7, END, 100.0)
    nameless = files.csv_prices(spark, _csv(tmp_path / "a", 120, "day,value"))
    rows = sorted(frame.collect())
    again = sorted(files.synthetic_prices(spark, 300, 7, END, 100.0).collect())
    assert source == "synthetic" and nameless is None and rows == again and len(rows) == 300
    assert rows[-1][0].date() == END and all(r[0].weekday() < 5 and r[1] > 0 for r in rows)
    with pytest.raises(ValueError):
        files.synthetic_prices(spark, 0, 7, END, 100.0)


@pytest.mark.parametrize("text, fault", [("", "malformed"), (None, "malformed"), ("{}", "not_an_array"), ("[1]", "not_objects"), ('[{"a":1,"a":2}]', "duplicate_keys"), ('[{"a":{}}]', "not_flat"), ('[{"a":NaN}]', "not_finite"), ('[{"a":1},{"a":2},{"a":3}]', "too_many_rows"), ('[{"a":"' + "x" * 90 + '"}]', "row_too_long")])
def test_json_rows_are_strict(spark, text, fault):
    frame = spark.createDataFrame([("f", text)], "path string, body string")
    got = files.json_rows(frame, "path", "body", most_rows=2, most_bytes=80).collect()
    assert [(r["row_number"], r["fault"]) for r in got] == [(0, fault)]


def test_json_rows_of_an_empty_array_are_none(spark):
    assert files.json_rows(spark.createDataFrame([("f", "[]")], "path string, body string"), "path", "body").count() == 0


def test_runs_are_listed_newest_first_and_never_overwritten(spark, tmp_path):
    root = str(tmp_path / "runs")
    assert runs.runs(spark, root) is None
    table = spark.range(3)
    for i in (1, 2):
        runs.write_run(spark, root, {"run_id": f"r{i}", "created_at": f"2025-01-0{i}"}, {"rows": table})
    with pytest.raises(Exception):
        runs.write_run(spark, root, {"run_id": "r1", "created_at": "2026-01-01"}, {"rows": table})
    assert [r["run_id"] for r in runs.runs(spark, root).collect()] == ["r2", "r1"]
    assert spark.read.parquet(f"{root}/r1/rows").count() == 3


def test_a_failed_run_keeps_its_error(spark, tmp_path):
    root = str(tmp_path / "runs")
    bad = spark.range(1).selectExpr("raise_error('no') as x")
    with pytest.raises(Exception):
        runs.write_run(spark, root, {"run_id": "r", "created_at": "2025-01-01"}, {"rows": bad})
    assert [r["status"] for r in runs.runs(spark, root).collect()] == ["failed"]


def test_append_new_keeps_equal_rows_once_and_refuses_others(spark, tmp_path):
    path, rows = str(tmp_path / "rows"), lambda *r: spark.createDataFrame(list(r), "k int, v string")
    runs.append_new(spark, path, rows((1, "a"), (1, "a"), (2, None)), "k", "v")
    got = {r["k"]: r["outcome"] for r in runs.append_new(spark, path, rows((2, None), (3, "c")), "k", "v").collect()}
    with pytest.raises(ValueError):
        runs.append_new(spark, path, rows((1, "b")), "k", "v")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, None), (3, "c")] and set(got) == {2, 3}


def test_feed_quotes_of_odd_messages(spark):
    at = datetime.datetime(2025, 1, 1)
    bodies = [None, "", "[]", '{"feeds": {}}', '{"feeds": {"A": {}}}', '{"feeds": {"A": {"ltpc": {"ltp": "NaN", "ltt": 1}}}}', '{"feeds": {"A": {"ltpc": {"ltp": 5, "ltt": "1735689600", "ltq": "-3"}}}}']
    got = feeds.feed_quotes(spark.createDataFrame([(b, at) for b in bodies], "payload string, at timestamp"), "payload", "at").collect()
    assert [(r["instrument"], r["price"], r["previous_close"], r["last_quantity"], r["traded_at"], r["provider_at"]) for r in got] == [("A", 5.0, None, None, at, at)]


def test_sequences_go_on_after_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame = lambda i: spark.createDataFrame([("a", float(i + j), datetime.datetime(2025, 1, 1, 0, i, j)) for j in range(3)], "instrument string, price double, received_at timestamp")
    for i in range(2):
        frame(i).coalesce(1).write.mode("append").parquet(source)
        stream = streams.sequenced(spark.readStream.schema(frame(0).schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [r["sequence"] for r in spark.read.parquet(out).orderBy("received_at").collect()] == [1, 2, 3, 4, 5, 6]


def test_an_instrument_without_eligible_rows_has_empty_metrics(spark):
    prices = spark.createDataFrame([("a", f"2025-01-{i + 10}", 100.0 + i) for i in range(4)], "instrument_id string, session_date string, price double")
    got = volatility.metrics(volatility.backtest(prices), ("naive", "ewma")).collect()
    assert len(got) == 4 and all(r["n_obs"] == 0 and r["mae"] is None for r in got)


def test_horizons_are_checked(spark):
    prices = spark.createDataFrame([("a", "2025-01-10", 1.0)], "instrument_id string, session_date string, price double")
    assert "annualized_variance_10d" in volatility.features(prices, (5, 10, 21)).columns
    with pytest.raises(ValueError):
        volatility.features(prices, (1, 5))
