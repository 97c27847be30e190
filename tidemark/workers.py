"""What Spark jobs of this package need around them: workers that can import it, and rows kept in the shared folder."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started."""
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, root])


def kept(frame: DataFrame) -> DataFrame:
    """The frame's rows, computed once and kept in the shared folder of spark.checkpoint.dir; only a session without that setting gets a folder of its own."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return frame.checkpoint()


def dealt(frame: DataFrame, key: str) -> DataFrame:
    """The rows of files dealt out by a key, into four partitions for each split of the files: however large the table is, what a task sorts or gathers stays as large."""
    return frame.repartition(4 * frame.rdd.getNumPartitions(), key)
