import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tidemark.operators import volatility  # noqa: E402
from tidemark.plans import desk, feeds, market, market_sql, records, registry, reports, stored_records, streams, wire_frames  # noqa: E402

QUERIES = registry.QUERIES | market.QUERIES | feeds.QUERIES | desk.QUERIES | wire_frames.QUERIES | records.QUERIES | streams.QUERIES | reports.QUERIES | stored_records.QUERIES
ORACLE_SQL = registry.ORACLE_SQL | market_sql.ORACLE_SQL | feeds.ORACLE_SQL | desk.ORACLE_SQL | wire_frames.ORACLE_SQL | records.ORACLE_SQL | streams.ORACLE_SQL | reports.ORACLE_SQL | stored_records.ORACLE_SQL
TABLES = ("orders", "events", "part", "lineitem", "customer")

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, D).toPandas()
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as from '{D}/{t}.parquet'")
    want = db.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    keys = [c for c in columns if got[c].dtype.kind != "f"]
    for c in columns:
        if c.endswith(("date", "expiry", "_at", "timestamp")) or c.startswith("target_"):
            got[c], want[c] = (pd.to_datetime(f[c]).astype("datetime64[us]") for f in (got, want))
    a, b = (f[columns].sort_values(keys).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1e-7)


def test_invalid_price_voids_two_returns(spark):
    rows = [("a", f"2025-01-0{i + 1}", p) for i, p in enumerate([100.0, 101.0, -1.0, 102.0, 103.0])]
    frame = spark.createDataFrame(rows, "instrument_id string, session_date string, price double")
    got = [r["log_return"] for r in volatility.returns(frame).orderBy("session_date").collect()]
    assert [x is None for x in got] == [True, False, True, True, False]


def test_ewma_decays_over_nulls_like_a_recursive_mean(spark):
    xs = [None, 1.0, 4.0, None, None, 2.0, 8.0, None, 3.0]
    frame = spark.createDataFrame([("a", f"2025-01-{i + 10}", x) for i, x in enumerate(xs)], "instrument_id string, session_date string, x double")
    got = volatility.ewma(frame, "x", 3).orderBy("session_date").toPandas()["ewma"]
    want = pd.Series(xs, dtype=float).ewm(span=3, adjust=False, min_periods=3).mean()
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_entry_survives_without_the_optional_operators():
    import __spark_entry__ as e

    assert "rv_features" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
