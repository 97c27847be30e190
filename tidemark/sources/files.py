"""Price files, synthetic series beside them, and strict rows of JSON arrays."""

from __future__ import annotations

import datetime
import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cleaned(raw: DataFrame, *place: str) -> DataFrame:
    """raw (date, close: texts; place columns): the last valid positive close of each moment, by place."""
    at, price = F.expr("try_cast(date as timestamp)"), F.expr("try_cast(close as double)")
    rows = raw.select(at.alias("session_date"), price.alias("price"), F.struct(*place).alias("place"))
    rows = rows.filter("session_date is not null and price > 0 and not isnan(price)")
    return rows.groupBy("session_date").agg(F.max_by("price", "place").alias("price"))


def csv_prices(spark: SparkSession, path: str, least: int = 100) -> DataFrame | None:
    """The prices of a CSV file with a date or timestamp and a close or price column; None without them or with fewer than `least` prices."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lower().strip(): c for c in raw.columns}
    date, close = (next((names[n] for n in wanted if n in names), None) for wanted in (("date", "timestamp"), ("close", "price")))
    if date is None or close is None:
        return None
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")]
    out = cleaned(raw.select(F.col(f"`{date}`").alias("date"), F.col(f"`{close}`").alias("close"), *place), "file", "start", "line")
    return out if out.limit(least).count() >= least else None


def synthetic_prices(spark: SparkSession, periods: int, seed: int, end: datetime.date, first: float, segments: tuple = ((0.0003, 0.007), (-0.0001, 0.017), (0.0004, 0.010))) -> DataFrame:
    """A seeded daily series of business days up to `end`, in segments of equal length with their own mean and deviation. A few thousand rows, made on the driver."""
    if periods < 1 or first <= 0:
        raise ValueError("periods and the first price must be positive")
    share = periods // len(segments)
    lengths = [share] * (len(segments) - 1) + [periods - share * (len(segments) - 1)]
    rng = np.random.default_rng(seed)
    steps = np.concatenate([rng.normal(mean, deviation, n) for (mean, deviation), n in zip(segments, lengths)])
    days = pd.bdate_range(end=pd.Timestamp(end), periods=periods)
    return spark.createDataFrame(pd.DataFrame({"session_date": days, "price": first * np.exp(np.cumsum(steps))}))


def price_dataset(spark: SparkSession, path: str | None, periods: int, seed: int, end: datetime.date, first: float, synthetic: bool = False) -> tuple[DataFrame, str]:
    """The file's prices, or a synthetic series where it is not wanted or not usable, and which of both."""
    found = None if synthetic or path is None else csv_prices(spark, path)
    return (found, "csv") if found is not None else (synthetic_prices(spark, periods, seed, end, first), "synthetic")


def json_rows(texts: DataFrame, name: str, text: str, most_rows: int = 1_000_000, most_bytes: int = 65_536) -> DataFrame:
    """Each text's rows, numbered from 1, as canonical JSON with its hash; a text that is no array of flat objects without repeated keys gives one row with the fault.

    A text is one provider file, of 250 MiB at most by contract, and is read by one task.
    """

    def strict(text: str) -> list[str]:
        """The rows of one JSON array as canonical texts; ValueError names what is wrong."""

        def flat(pairs):
            if len(dict(pairs)) != len(pairs):
                raise ValueError("duplicate_keys")
            if any(isinstance(v, (dict, list)) for _, v in pairs):
                raise ValueError("not_flat")
            return dict(pairs)

        def no_constant(name):
            raise ValueError("not_finite")

        try:
            rows = json.loads(text, object_pairs_hook=flat, parse_constant=no_constant)
        except json.JSONDecodeError:
            raise ValueError("malformed") from None
        if not isinstance(rows, list):
            raise ValueError("not_an_array")
        if any(not isinstance(r, dict) for r in rows):
            raise ValueError("not_objects")
        return [json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in rows]

    def rows(batches):
        for batch in batches:
            for key, body in zip(batch[name], batch[text]):
                try:
                    found = strict(body or "")
                    if len(found) > most_rows:
                        raise ValueError("too_many_rows")
                    if any(len(r.encode()) > most_bytes for r in found):
                        raise ValueError("row_too_long")
                except ValueError as fault:
                    yield pd.DataFrame({name: [key], "row_number": [0], "row": [None], "row_hash": [None], "fault": [str(fault)]})
                    continue
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pd.DataFrame({name: key, "row_number": range(at + 1, at + 1 + len(part)), "row": part, "row_hash": [hashlib.sha256(r.encode()).hexdigest() for r in part], "fault": None})

    kind = texts.schema[name].dataType.simpleString()
    return texts.select(name, text).mapInPandas(rows, f"`{name}` {kind}, row_number long, row string, row_hash string, fault string")
