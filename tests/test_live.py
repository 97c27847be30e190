"""Live freshness over restarts and by both clocks; recomputed features after every batch and after a replay."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import volatility
from tidemark.streaming import freshness, recompute

KIND = "instrument string, price double, traded_at timestamp, received_at timestamp, kind string"
T = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def feed(session, folder, *rows):
    """rows: instrument, price, second of receipt, kind."""
    session.createDataFrame([(i, p, T(s), T(s), k) for i, p, s, k in rows], KIND).coalesce(1).write.mode("append").parquet(folder)


def run(session, tmp, **options):
    stream = freshness.followed(session.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in"), seconds=5, **options)
    stream.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted((r["instrument"], r["sequence"], r["freshness"], r["price"]) for r in session.read.parquet(f"{tmp}/out").collect())


def test_quotes_turn_stale_as_the_watermark_moves_and_state_survives_restarts(session, tmp_path):
    tmp = str(tmp_path)
    feed(session, f"{tmp}/in", ("a", 1.0, 0, None), ("b", 2.0, 4, None), ("a", -1.0, 3, None), ("a", float("nan"), 3, None), ("a", float("inf"), 3, None))
    first = run(session, tmp)
    assert first == [("a", 1, "fresh", 1.0), ("b", 1, "fresh", 2.0)]
    # five seconds after its receipt a's quote is fresh still
    feed(session, f"{tmp}/in", ("c", 3.0, 5, None))
    assert run(session, tmp) == [*first, ("c", 1, "fresh", 3.0)]
    feed(session, f"{tmp}/in", ("c", 3.5, 6, None))
    third = sorted([*first, ("a", 1, "stale", 1.0), ("c", 1, "fresh", 3.0), ("c", 2, "fresh", 3.5)])
    assert run(session, tmp) == third
    # numbers go on after a restart; a lost connection makes stale at once, and only once
    feed(session, f"{tmp}/in", ("a", 1.5, 7, None), ("a", None, 8, "down"), ("a", None, 8, "down"), ("z", None, 8, "down"))
    assert run(session, tmp) == sorted([*third, ("a", 2, "fresh", 1.5), ("a", 2, "stale", 1.5)])


def test_future_trades_are_not_accepted(session, tmp_path):
    rows = [("a", 1.0, T(301), T(0), None), ("b", 1.0, T(300), T(0), None), ("c", 1.0, None, T(0), None), ("d", 1.0, T(0), None, None)]
    session.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/in")
    assert [r[0] for r in run(session, str(tmp_path))] == ["b"]


def test_quotes_turn_stale_by_the_machines_clock(session, tmp_path):
    tmp = str(tmp_path)
    feed(session, f"{tmp}/in", ("a", 1.0, 0, None))
    stream = freshness.followed(session.readStream.schema(KIND).parquet(f"{tmp}/in"), seconds=1, clock="processing")
    query = stream.writeStream.format("memory").queryName("by_clock").option("checkpointLocation", f"{tmp}/state").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and session.table("by_clock").filter("freshness = 'stale'").isEmpty():
            time.sleep(0.3)
        assert sorted(r["freshness"] for r in session.table("by_clock").collect()) == ["fresh", "stale"]
    finally:
        query.stop()


@pytest.fixture(scope="module")
def prices(session):
    days = session.range(260).select(F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("session_date"), "id")
    rows = days.crossJoin(session.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "instrument_id string, k int"))
    return rows.select("instrument_id", "session_date", (100 + F.sin(F.col("id") * F.col("k")) * 5 + F.pmod(F.col("id") * 7919, F.lit(13))).alias("price"))


def values(frame):
    columns = sorted(c for c in frame.columns if c not in recompute.KEYS)
    return {(r["instrument_id"], r["session_date"]): [None if r[c] is None else r[c] if isinstance(r[c], str) else round(r[c], 9) for c in columns] for r in frame.collect()}


def test_recomputed_features_equal_a_full_recompute(session, prices, tmp_path):
    root = str(tmp_path / "live")
    day = F.dayofyear("session_date")
    batches = [prices.filter((day < 200) & (day != 150)), prices.filter((day >= 200) & (F.col("instrument_id") == "a")), prices.filter((day == 150) & (F.col("instrument_id") != "c")), prices.limit(0), prices.filter((day == 190) & (F.col("instrument_id") == "b")).withColumn("price", F.lit(250.0))]
    seen = None
    for number, batch in enumerate(batches):
        for _ in range(1 + (number == 2)):  # the third batch runs twice
            recompute.refresh(session, root, batch, number)
        mine = batch.withColumn("batch", F.lit(number))
        seen = mine if seen is None else seen.unionByName(mine)
        full = volatility.features(seen.groupBy(*recompute.KEYS).agg(F.max_by("price", "batch").alias("price")))
        if number != 1:
            assert values(recompute.current(session, root, "features")) == values(full)
    # only the touched tails are read and written
    assert session.read.parquet(f"{root}/features/batch=4").select("instrument_id").distinct().count() == 1
    assert session.read.parquet(f"{root}/features/batch=4").agg(F.min(F.dayofyear("session_date"))).first()[0] == 190
    rows = recompute.tail(prices, prices.filter((day == 190) & (F.col("instrument_id") == "b")), 10)
    assert rows.count() == 10 + 260 - 189 and rows.select("instrument_id").distinct().count() == 1
