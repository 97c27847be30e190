"""Quality classification by a regularised quadratic discriminant.

Transformed statistics of whole texts are standardised; each class has a mean and a covariance shrunk
towards its diagonal; the score is the posterior from the difference of Mahalanobis log densities with
cached Cholesky factors. Sums for the fit are made by Spark over all labelled training rows.

Null texts count as empty and get a score like all others. Labels of unknown documents and null labels
teach nothing; several labels of one document count as its greatest; without rows of both classes the
score is the share of good labels (0.5 without any). Repeated rows and null ids each get a row; texts of any
length are read whole; equal texts have equal scores; an empty table gives an empty result; further columns
are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import ready, saved, table
from .language import remainder

SHRINK, THRESHOLD = 0.1, 0.3
_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line": b"\n\r", "stop": b".", "comma": b",;:", "shout": b"!?", "bar": b"|#*=_~<>{}[]()/\\@&%$+^`", "quote": b"\"'-"}
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members)] = _i
_N = len(_CLASSES) + 1
FEATURES = [*_CLASSES, "other", "bytes", "words", "word_length", "distinct_words", "distinct_lines", "line_length"]


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, features): square roots of character shares, logarithms of sizes, and shares of distinct words and lines."""
    data, offsets = _text.buffer(column)
    size = np.diff(offsets)
    shares = np.empty((len(size), _N))
    for lo, hi in _text.chunks(offsets):
        cls = _CLASS[data[offsets[lo] : offsets[hi]]] + np.repeat(np.arange(hi - lo) * _N, size[lo:hi])
        shares[lo:hi] = np.bincount(cls, minlength=(hi - lo) * _N).reshape(-1, _N)
    shares = np.sqrt(shares / np.maximum(size, 1)[:, None])
    rest = np.empty((len(size), 6))
    for i, t in enumerate(column.to_pylist()):
        words, lines = (t or "").split(), (t or "").split("\n")
        n = len(words)
        rest[i] = (np.log1p(size[i]), np.log1p(n), np.log1p(size[i] / max(n, 1)), len(set(words)) / max(n, 1), len(set(lines)) / len(lines), np.log1p(size[i] / len(lines)))
    return np.concatenate([shares, rest], 1)


def features(docs: DataFrame) -> DataFrame:
    def work(batches):
        for b in _text.portions(batches, 1):
            x = statistics(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, x array<double>")


class Discriminant:
    def __init__(self, moments: dict[int, np.ndarray], shrink: float = SHRINK):
        """moments: for each class the sum of outer products of [1, x]."""
        n = {k: m[0, 0] for k, m in moments.items()}
        good, bad = n.get(1, 0.0), n.get(0, 0.0)
        self.prior, self.parts = (good + 1) / (good + bad + 2), None
        if good > 1 and bad > 1:
            both = moments[0] + moments[1]
            self.mean = both[0, 1:] / both[0, 0]
            self.scale = np.sqrt(np.maximum(np.diag(both)[1:] / both[0, 0] - self.mean**2, 1e-9))
            self.parts = {}
            for k in (0, 1):
                m, mu = moments[k] / n[k], moments[k][0, 1:] / n[k]
                cov = (m[1:, 1:] - np.outer(mu, mu)) / np.outer(self.scale, self.scale)
                spread = np.diag(cov)
                cov = (1 - shrink) * cov + shrink * np.diag(0.5 * spread + 0.5 * spread.mean()) + 1e-3 * np.eye(len(mu))
                chol = np.linalg.cholesky(cov)
                self.parts[k] = ((mu - self.mean) / self.scale, np.linalg.inv(chol).T, -np.log(np.diag(chol)).sum() + np.log(n[k] / (good + bad)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        x = (x - self.mean) / self.scale
        log = {k: c - 0.5 * (((x - mu) @ root) ** 2).sum(1) for k, (mu, root, c) in self.parts.items()}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(known: DataFrame, shrink: float = SHRINK) -> Discriminant:
    """known: x array<double>, y int. Each task sums moments; only one matrix per class comes to the driver."""
    p = len(FEATURES) + 1

    def sums(frames):
        total: dict = {}
        for f in frames:
            x = np.column_stack([np.ones(len(f)), np.stack(f["x"].to_numpy())]) if len(f) else np.zeros((0, p))
            for k in (0, 1):
                some = x[f["y"].to_numpy() == k]
                total[k] = total.get(k, 0) + some.T @ some
        for k, m in total.items():
            yield pd.DataFrame({"y": k, "cell": np.arange(p * p), "value": m.ravel()})

    rows = known.mapInPandas(sums, "y int, cell int, value double").groupBy("y", "cell").agg(F.sum("value")).collect()
    moments = {k: np.zeros(p * p) for k in (0, 1)}
    for y, cell, value in rows:
        moments[y][cell] = value
    return Discriminant({k: m.reshape(p, p) for k, m in moments.items()}, shrink)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    def work(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            yield pa.record_batch([b.column(0), pa.array(model.score(x) if len(x) else np.zeros(0))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(work, "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = saved(features(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").filter("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    known = stats.filter(remainder(5) != 0).join(labels, "doc_id").select("x", "y")
    scored = score(stats, fit(known))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
