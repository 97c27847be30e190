"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled texts.
Gates are
piecewise linear and candidates softsign, which cost far less than exponentials. It reads a whole text in windows of bytes, labels every position, and averages the positions' class
probabilities over the document.

A text that is null or has no letter is `und` with score 0; rows without a language teach nothing;
without any labelled row every text is `und`. Repeated rows and null ids each get a row; texts of any length
are read whole; of equally probable languages the first by name is taken; an empty table gives an empty
result; further columns are left out by `identify` and kept by `tagged`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import ready, table

HIDDEN, WINDOW, PAD = 8, 128, 256
#: Labelled texts of each language to learn from, one window of each; the bound of the training sample.
SAMPLE, STEPS, BATCH, RATE = 800, 200, 128, 0.03


class Network:
    """Both directions run side by side: the state is [forward, backward] and the recurrent weights are block-diagonal."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 5):
        r = np.random.Generator(np.random.PCG64(seed))
        h, self.h, self.classes = hidden, hidden, classes
        make = lambda *s: r.normal(0, 1 / np.sqrt(s[-2]) if len(s) == 3 else 0.5, s).astype(np.float32)
        # directions x bytes x (reset, update, candidate), directions x state x the same three
        self.p = {"x": make(2 * 257, 3 * h).reshape(2, 257, 3 * h), "u": make(2, h, 3 * h), "o": make(1, 2 * h, len(classes))[0], "b": np.zeros(len(classes), np.float32)}

    def _inputs(self) -> np.ndarray:
        x = self.p["x"].copy()
        x[:, PAD] = 0
        x[:, PAD, self.h : 2 * self.h] = 30  # padding keeps the state
        return x

    def states(self, x: np.ndarray, keep: bool = False):
        """States (time, batch, 2h) for bytes (time, batch); with keep also what learning needs."""
        steps, n = x.shape
        h, inputs, u = self.h, self._inputs(), self.p["u"]
        out, kept = [], []
        for d in (0, 1):
            state, hs = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
            gates, w = inputs[d], u[d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a, b = gates[x[t]], state @ w
                rz = a[:, : 2 * h] + b[:, : 2 * h]
                rz += 0.5
                np.clip(rz, 0, 1, out=rz)
                cand = rz[:, :h] * b[:, 2 * h :]
                cand += a[:, 2 * h :]
                cand /= 1 + np.abs(cand)
                new = hs[t]
                np.subtract(state, cand, out=new)
                new *= rz[:, h:]
                new += cand
                if keep:
                    kept.append((d, t, state, rz, cand, b[:, 2 * h :]))
                state = new
            out.append(hs)
        return out, kept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(classes, time, batch): every position's label probabilities. Units come first, so that each step works on contiguous rows."""
        steps, n = x.shape
        h, inputs, out = self.h, self._inputs(), self.p["o"].T
        z = np.empty((len(self.classes), steps, n), np.float32)
        z[:] = self.p["b"][:, None, None]
        a, b, hs = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((h, steps, n), np.float32)
        for d in (0, 1):
            gates, w = inputs[d].T.copy(), self.p["u"][d].T.copy()
            gates[: 2 * h] += 0.5
            state = np.zeros((h, n), np.float32)
            rz, cand = a[: 2 * h], a[2 * h :]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(gates, x[t], axis=1, out=a, mode="clip")
                np.dot(w, state, out=b)
                rz += b[: 2 * h]
                np.maximum(rz, 0, out=rz)
                np.minimum(rz, 1, out=rz)
                b[2 * h :] *= rz[:h]
                cand += b[2 * h :]
                size = np.abs(cand, out=b[:h])
                size += 1
                cand /= size
                state -= cand
                state *= rz[h:]
                state += cand
                hs[:, t] = state
            z += (out[:, d * h : d * h + h] @ hs.reshape(h, -1)).reshape(z.shape)
        z -= z.max(0)
        np.exp(z, out=z)
        z /= z.sum(0)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross-entropy over real positions, and its gradients by backpropagation through time."""
        h, (both, kept) = self.h, self.states(x, keep=True)
        hs = np.concatenate(both, -1)
        z = hs @ self.p["o"] + self.p["b"]
        z -= z.max(-1, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(-1, keepdims=True)
        real = (x != PAD).astype(np.float32)
        total = max(float(real.sum()), 1.0)
        picked = np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (*x.shape, 1)), -1)[..., 0]
        loss = float(-(np.log(picked + 1e-12) * real).sum() / total)
        dz = prob.copy()
        np.put_along_axis(dz, np.broadcast_to(y[None, :, None], (*x.shape, 1)), picked[..., None] - 1, -1)
        dz *= real[..., None] / total
        flat = dz.reshape(-1, dz.shape[-1])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["b"] = hs.reshape(-1, 2 * h).T @ flat, flat.sum(0)
        dh = dz @ self.p["o"].T
        carry = [np.zeros((x.shape[1], h), np.float32) for _ in (0, 1)]
        for d, t, before, rz, cand, hu in reversed(kept):
            dnew = dh[t, :, d * h : d * h + h] + carry[d]
            r, zg = rz[:, :h], rz[:, h:]
            dc = dnew * (1 - zg) * (1 - np.abs(cand)) ** 2
            da = np.concatenate([dc * hu * ((r > 0) & (r < 1)), dnew * (before - cand) * ((zg > 0) & (zg < 1)), dc], 1)
            db = da.copy()
            db[:, 2 * h :] = dc * r
            g["u"][d] += before.T @ db
            np.add.at(g["x"][d], x[t], da)
            carry[d] = dnew * zg + db @ self.p["u"][d].T
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> float:
        """Adam with a falling rate over shuffled batches of (window, time) bytes; the last step's loss."""
        r, loss, order = np.random.Generator(np.random.PCG64(seed)), 0.0, np.zeros(0, np.int64)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in (0, 1))
        for step in range(1, steps + 1):
            while len(order) < batch:
                order = np.concatenate([order, r.permutation(len(x))])
            some, order = order[:batch], order[batch:]
            loss, g = self.gradients(np.ascontiguousarray(x[some].T), y[some])
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                now = rate * (1 - (step - 1) / steps)
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def pooled(self, data: np.ndarray, offsets: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """(documents, classes): class probabilities averaged over all bytes of each document."""
        n = np.diff(offsets)
        many = -(-n // WINDOW)
        doc = np.repeat(np.arange(len(n)), many)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
        length = np.minimum(n[doc] - start, WINDOW)
        start += offsets[:-1][doc]
        out, step = np.zeros((len(n), len(self.classes))), np.arange(WINDOW)
        for lo in range(0, len(doc), at_once):
            s, k = start[lo : lo + at_once, None], length[lo : lo + at_once, None]
            real = step < k
            x = np.where(real, data[np.minimum(s + step, len(data) - 1)], PAD).T
            prob = self.probabilities(np.ascontiguousarray(x))
            prob *= real.T
            np.add.at(out, doc[lo : lo + at_once], prob.sum(1).T)
        return out / np.maximum(n, 1)[:, None]


def windows(texts: list[str]) -> np.ndarray:
    out = np.full((len(texts), WINDOW), PAD, np.int64)
    for row, t in zip(out, texts):
        b = np.frombuffer((t or "").encode("utf-8", "surrogatepass")[:WINDOW], np.uint8)
        row[: len(b)] = b
    return out


def train(labelled: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learns from about `sample` texts of each language, picked by a hash of the id; one window at a hashed place of each."""
    usable = labelled.filter("text is not null and lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n))])
    luck = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    place = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - WINDOW)).cast("int") + 1
    picked = usable.filter(luck < share[F.col("lang")]).select("doc_id", "lang", F.substring("text", place, F.lit(WINDOW)).alias("part"))
    rows = sorted(picked.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["part"]))  # about `sample` rows per language
    classes = sorted(counts)
    net = Network(classes)
    net.fit(windows([r["part"] for r in rows]), np.array([classes.index(r["lang"]) for r in rows]))
    return net


def _judge(texts: pa.Array, net: Network | None) -> tuple[np.ndarray, np.ndarray]:
    """The language and its probability of every text; 'und' and 0 without a letter or a network."""
    letter = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
    names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
    if net is not None and len(texts):
        data, offsets = _text.buffer(texts)
        if len(data):
            prob = net.pooled(data, offsets)
            best = prob.argmax(1)
            names[letter] = np.array(net.classes, object)[best[letter]]
            scores[letter] = np.minimum(prob[np.arange(len(best)), best], 1.0)[letter]
    return names, scores


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    ready(docs.sparkSession)

    def work(batches):
        for batch in batches:
            names, scores = _judge(batch.column(1), net)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def tagged(docs: DataFrame, net: Network | None) -> DataFrame:
    """The document rows with a recognised language, which lang carries; all other columns as they are."""
    ready(docs.sparkSession)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def work(batches):
        for batch in _text.portions(batches, text):
            names, _ = _judge(batch.column(text), net)
            batch = batch.set_column(lang, batch.schema.field(lang), pa.array(names, batch.schema.field(lang).type))
            yield batch.filter(pa.array(names != "und", pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def remainder(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.filter(remainder(4) != 2)))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
