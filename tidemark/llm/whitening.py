"""Whitening of embedding vectors by matrix-free block subspace iteration.

An entry c becomes the long x = floor(1024 * c) + 100000. Each Spark pass multiplies the covariance of x with a
block Q as X'(XQ) over centred rows, so that no matrix of d x d is ever made on the executors. The driver
orthogonalises the residuals of the block by QR, and its Rayleigh-Ritz step uses all blocks since the last
restart, until the residual of each of the k components is small against the gap to its neighbours.
Counts and sums of x are exact integers, and rows are centred as n * x - S before they are rounded.

Rows whose vector is null, or holds null, NaN, infinite or so large entries that x is no long, are left out. The
dimension is the most frequent length of the remaining vectors (of equally frequent ones the greatest); vectors
of other lengths are left out too, as no covariance holds them. Repeated rows and null ids each count and are
returned. Components without variance, beyond the rank of the data, do not exist: without two different vectors,
as in an empty table, the result is empty. A deviation that no long can hold is null. Of an eigenvector's two
signs the one whose largest entry is positive is taken. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import ready, table

COMPONENTS, SCALE, SHIFT = 8, 1024, 100000
#: Residuals count as certified below this share of the gap, or below that share of the greatest eigenvalue.
TOLERANCE, FLOOR, FLAT, PASSES = 1e-9, 3e-13, 1e-11, 500
#: Entries of vectors that a task holds as doubles at a time.
ENTRIES = 1 << 21


@dataclass
class Model:
    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def weights(self) -> np.ndarray:
        """What turns a centred row into its whitened components."""
        return self.vectors / np.sqrt(self.values)


def usable(frame: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and vector (as double) of the rows that can be whitened, of the most frequent length."""
    rows = frame.select(F.col(f"`{key}`").alias(key), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    beyond = F.lit(float(2**63 - 2**20) / SCALE)
    rows = rows.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= beyond)))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("vector") == (length[0]["d"] if length else 0))


def integers(batch: pa.RecordBatch, column: int, d: int):
    """Slices of a batch with their x as (rows, d) longs."""
    step = max(1, ENTRIES // max(d, 1))
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        yield part, np.floor(SCALE * part.column(column).flatten().to_numpy().reshape(part.num_rows, d)).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers where they hold it, else as Python's."""
    most = n * int(max(-x.min(), x.max(), 0)) + max(map(abs, total)) if x.size else 0
    return n * x - np.array(total) if most < 2**63 else n * x.astype(object) - np.array(total, object)


def _centre(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return np.array(centred(x, n, total) / n, np.float64)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension, as high and low halves that cannot overflow within a task."""

    def work(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for part, x in integers(batch, 0, d):
                n, high, low = n + part.num_rows, high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.record_batch([pa.array(np.arange(d + 1)), pa.array(np.append(high, 0)), pa.array(np.append(low, n))], ["cell", "high", "low"])

    cells = rows.select("vector").mapInArrow(work, "cell long, high long, low long").groupBy("cell")
    got = {r["cell"]: int(r["high"]) * 2**32 + int(r["low"]) for r in cells.agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).collect()}
    return got.get(d, 0), [got.get(j, 0) for j in range(d)]


def _summed(rows: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all rows of a matrix made of each slice's x; tasks add up their own, Spark adds cell by cell."""

    def work(batches):
        out = np.zeros(shape)
        for batch in batches:
            for _, x in integers(batch, 0, d):
                out += part(x)
        yield pa.record_batch([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["cell", "value"])

    out = np.zeros(shape[0] * shape[1])
    for r in rows.select("vector").mapInArrow(work, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out.reshape(shape)


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The directions of a block's columns that a basis lacks."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 1e-10 * max(norms.max(initial=0), 1e-300)]
        block, r = np.linalg.qr(block / np.maximum(np.linalg.norm(block, axis=0), 1e-300))
        block = block[:, np.abs(np.diag(r)) > 1e-10]
    return block


def iterate(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric positive matrix of d x d and their vectors, from its products with blocks."""
    k = min(k, d)
    block = min(d, block or 2 * k)
    most = max(8 * block, 4 * k)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    new = np.linalg.qr(np.random.Generator(np.random.PCG64(11)).normal(size=(d, block)))[0]
    for _ in range(PASSES):
        if basis.shape[1] + new.shape[1] > most:
            basis, image = basis @ turn[:, : 2 * block], image @ turn[:, : 2 * block]  # noqa: F821  the last round's
        basis, image = np.hstack([basis, new]), np.hstack([image, multiply(new)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn[:, :block]
        residual = image @ turn[:, :block] - ritz * values[:block]
        size = np.linalg.norm(residual[:, :k], axis=0)
        gaps = np.abs(np.diff(values[: k + 1], append=[] if len(values) > k else [0.0]))
        gap = np.minimum(gaps[:k], np.concatenate([[np.inf], gaps[: k - 1]]))
        real = values[:k] > FLAT * values[0]
        if basis.shape[1] == d or values[0] <= 0 or np.all(~real | (size <= np.maximum(TOLERANCE * gap, FLOOR * values[0]))):
            break
        new = _orthonormal(residual[:, np.linalg.norm(residual, axis=0) > 1e-15 * values[0]], basis)
        if not new.shape[1]:
            break
    else:
        raise RuntimeError(f"not certified after {PASSES} passes")
    vectors = ritz[:, :k][:, real]
    return values[:k][real], vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def fit(rows: DataFrame, k: int = COMPONENTS, block: int | None = None) -> Model | None:
    """A model of the usable rows; None where they have no variance."""
    ready(rows.sparkSession)
    first = rows.select(F.size("vector").alias("d")).limit(1).collect()
    d = first[0]["d"] if first else 0
    n, total = sums(rows, d) if d else (0, [])
    if not n:
        return None
    trace = float(_summed(rows, (1, 1), lambda x: (_centre(x, n, total) ** 2).sum().reshape(1, 1), d)[0, 0]) / n
    if not trace > 0:
        return None

    def multiply(q: np.ndarray) -> np.ndarray:
        def part(x):
            y = _centre(x, n, total)
            return y.T @ (y @ q)

        return _summed(rows, q.shape, part, d) / n

    model = Model(n, total, *iterate(multiply, d, k, block), trace)
    weights = model.weights

    def outer(x):
        y = _centre(x, n, total) @ weights
        return y.T @ y

    k = weights.shape[1]
    model.identity_error = float(np.abs(_summed(rows, (k, k), outer, d) / n - np.eye(k)).max())
    return model


def transform(rows: DataFrame, model: Model) -> DataFrame:
    """key, deviation (sum over dimensions of (n * x - S)^2) and whitened array<double> of every usable row."""
    key, d, weights, n, total = rows.columns[0], len(model.total), model.weights, model.n, model.total

    def work(batches):
        for batch in batches:
            for part, x in integers(batch, 1, d):
                off = centred(x, n, total)
                most = max(abs(int(off.max())), abs(int(off.min())))
                deviation = ((off if d * most**2 < 2**63 else off.astype(object)) ** 2).sum(1).tolist()
                white = np.array(off / n, np.float64) @ weights
                yield pa.record_batch([part.column(0), pa.array([v if v < 2**63 else None for v in deviation], pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], [key, "deviation", "whitened"])

    return rows.select(key, "vector").mapInArrow(work, f"`{key}` {rows.schema[0].dataType.simpleString()}, deviation long, whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    model = fit(rows)
    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], names)
    explained = F.array(*(F.lit(float(e)) for e in model.values / model.trace))
    each = transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(F.col("vec_id").cast("long"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))
