"""Corpus preparation from raw documents to packed training sequences.

Each stage reads what its predecessor wrote. All but the last return the columns of documents.

Every row is judged by its own text, whatever its id: null ids are kept like others, and of several texts
under one id each stays, goes or is redacted on its own. Repeated rows are one group of near duplicates. Null and empty
texts have no recognisable language and go at the first stage. Texts are read whole, whatever their length. Of ties the
least id stays, then the least hash of the row. An empty table stays empty through all stages. Further columns are kept, and
the helper columns of a stage have names that no column of its input has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard, language, packing, secrets
from tidemark.llm._spark import ready, saved, table

#: The word windows over tokens, the network and the packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; the others carry the recognised one."""
    return language.tagged(docs, language.train(docs.filter(language.remainder(4) != 2)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group stays: that of the least id, null last, then of the least hash of its row.

    Documents without words are linked with nothing and stay.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    named = jaccard.labelled(docs.select("doc_id", "text", row.alias("row")))
    keys = saved(named.groupBy("label", "doc_id", "row", (F.col("n_shingles") > 0).alias("words")).agg(F.count(F.lit(1)).alias("n")))
    least = keys.filter("words").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least"))
    least = least.select(F.col("least.doc_id").alias("least_id"), F.col("least.row").alias("least_row"))
    chosen = keys.filter("words").join(least, F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("row") == F.col("least_row")), "left_semi")
    mark = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any name of the table, so no column is called like it
    ident, own, again = f"{mark}i", f"{mark}r", f"{mark}n"
    chosen = saved(chosen.unionByName(keys.filter("not words")).select(F.col("doc_id").alias(ident), F.col("row").alias(own), (F.col("words") & (F.col("n") > 1)).alias(again)))

    def kept(some: DataFrame) -> DataFrame:
        return docs.join(some, F.col("doc_id").eqNullSafe(F.col(ident)) & (row == F.col(own)), "left_semi")

    return kept(chosen.filter(~F.col(again))).unionByName(kept(chosen.filter(again)).dropDuplicates())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; documents without any stay as they are."""
    return secrets.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(saved(packing.pieces(docs, packing.vocabulary())))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared checkpoint folder and read again."""
    ready(spark)
    docs, folder = table(spark, sf_dir, "documents"), f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
