"""Small helpers shared by the operators: checkpoints in the cluster's shared folder and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and makes sure that checkpoint() has a folder.

    On a cluster the folder comes from spark.checkpoint.dir; only a session without that setting
    (a local test) gets a temporary one.
    """
    context = spark.sparkContext
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        context.environment["PYTHONPATH"] = ":".join([*paths, ROOT])
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark


def saved(frame: DataFrame) -> DataFrame:
    """The frame's rows, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ready(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame) -> DataFrame:
    """The frame's rows, written as a table in the shared checkpoint folder and read again: the new plan knows nothing of the old one, as loops need."""
    spark = ready(frame.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
