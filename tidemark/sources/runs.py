"""Stored runs and immutable rows, on any path that Spark writes."""

from __future__ import annotations

import contextlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lookups
from tidemark.sources.store import put_if_absent


def write_run(spark: SparkSession, root: str, manifest: dict, tables: dict[str, DataFrame]) -> str:
    """Writes a run's tables under root/run_id and its manifest last, so that a listing never shows half a run.

    The run's id is claimed first, in one step: a second run of an id, at any time, raises CommitConflict before it has
    written anything. Nothing is ever overwritten; a failure is kept in the manifest and raised as it is.
    """
    home = f"{root.rstrip('/')}/{manifest['run_id']}"
    put_if_absent(spark, f"{home}/claim", json.dumps(manifest, sort_keys=True, default=str).encode())

    def close(status: dict) -> None:
        body = json.dumps(manifest | status, sort_keys=True)
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{home}/manifest")

    try:
        for name, frame in tables.items():
            frame.write.mode("errorifexists").parquet(f"{home}/{name}")
    except Exception as error:
        with contextlib.suppress(Exception):  # the first error counts
            close({"status": "failed", "error": type(error).__name__})
        raise
    close({"status": "completed", "error": None})
    return home


def runs(spark: SparkSession, root: str, needed: tuple[str, ...] = ("run_id", "created_at", "status")) -> DataFrame | None:
    """The manifests of a root, newest first, without those that lack a needed field; None where there is no run."""
    try:
        found = spark.read.json(f"{root.rstrip('/')}/*/manifest")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if not set(needed) <= set(found.columns):
        return found.limit(0)
    return found.dropna(subset=list(needed)).orderBy(F.desc("created_at"), F.desc("run_id"))


def append_new(spark: SparkSession, path: str, incoming: DataFrame, key: str, *content: str) -> DataFrame:
    """Appends the rows whose key is not stored yet and returns the outcome of each key; raises before writing where equal keys differ in content."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = incoming.limit(0)
    outcome = lookups.inserts(stored, incoming, key, *content)
    if not outcome.filter("outcome = 'collision'").isEmpty():
        raise ValueError(f"rows of equal {key} differ in content")
    fresh = incoming.join(outcome.filter("outcome = 'new'").select(key), key, "left_semi").dropDuplicates([key])
    fresh.write.mode("append").parquet(path)
    return outcome


def write_csv(frame: DataFrame, path: str, *order: str) -> None:
    """One CSV file with a header, in order: for reports of bounded length such as features and forecast history."""
    frame.orderBy(*order).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)
