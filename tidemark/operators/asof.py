"""Point-in-time reads: the latest state of each key as known at a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, clock: str, order: str, as_of, values: list[str]) -> DataFrame:
    """One row per key: the values of its last event up to as_of; ties go to the greatest order. One partial aggregation, no sort."""
    last = F.max_by(F.struct(clock, order, *values), F.struct(clock, order)).alias("last")
    return events.filter(F.col(clock) <= F.lit(as_of)).groupBy(key).agg(last).select(key, "last.*")


def knowledge_leaves(records: DataFrame, known_as_of) -> DataFrame:
    """Of records (record_id, supersedes_record_id, recorded_at), those known at a moment that no other known record supersedes."""
    known = records.filter(F.col("recorded_at") <= F.lit(known_as_of))
    replaced = known.select(F.col("supersedes_record_id").alias("record_id")).dropna()
    return known.join(replaced, "record_id", "left_anti")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
