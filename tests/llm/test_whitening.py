"""Whitening against a dense eigendecomposition, and its hard rows."""

import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import queries, whitening


def known(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100000
    n, total = len(x), x.sum(0)
    off = n * x - total
    values, turn = np.linalg.eigh((off / n).T @ (off / n) / n)
    return off, values[::-1], turn[:, ::-1]


def test_query(spark, folder):
    raw = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    fine = [(k, v) for k, v in raw if v and len(v) > 2 and all(c is not None and math.isfinite(c) and abs(c) < 1e20 for c in v)]
    off, values, turn = known([v for _, v in fine])
    n = len(fine)
    white = off / n @ turn[:, :8] / np.sqrt(values[:8])
    got = [r.asDict() for r in queries.QUERIES["op11_whitening"](spark, folder).collect()]
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((k, c) for k, _ in fine for c in range(1, 9))
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for r in got:
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9
    for c in range(1, 9):
        mine = sorted((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in got if r["component"] == c)
        want = [(str(k), int(d), w) for (k, _), d, w in zip(fine, (off**2).sum(1), white[:, c - 1])]
        ways = [max(abs(a[2] - b[2]) for a, b in zip(mine, sorted((k, d, s * w) for k, d, w in want))) for s in (1, -1)]
        assert min(ways) < 1e-8
        assert Counter(m[:2] for m in mine) == Counter(w[:2] for w in want)


def test_few_vectors_have_as_many_components_as_their_rank(spark):
    def fit(rows):
        return whitening.fit(whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))

    assert fit([]) is None and fit([(1, [1.0, 2.0])]) is None and fit([(1, [1.0, 2.0])] * 5) is None and fit([(1, [])]) is None
    model = fit([(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0])])
    assert len(model.values) == 1 and model.identity_error < 1e-12


def test_large_entries_are_exact(spark):
    rows = [(i, [2.0**40 * i, 1.0]) for i in range(4)]
    frame = whitening.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    model = whitening.fit(frame)
    x = [int(1024 * v[0]) + 100000 for _, v in rows]
    assert model.total == [sum(x), 4 * 101024]
    want = {i: (4 * x[i] - sum(x)) ** 2 for i in range(4)}
    got = {r["vec_id"]: r["deviation"] for r in whitening.transform(frame, model).collect()}
    assert got == {i: (v if v < 2**63 else None) for i, v in want.items()}


@pytest.mark.parametrize("kind", ["decaying", "flat", "equal", "few"])
def test_subspace_iteration_with_restarts(kind):
    r = np.random.default_rng(2)
    d = 240
    values = {"decaying": 0.9 ** np.arange(d), "flat": np.linspace(2, 1, d), "equal": np.repeat([3.0, 2.0, 1.0], 80), "few": np.append([5.0, 4.0, 3.0], np.zeros(d - 3))}[kind]
    turn = np.linalg.qr(r.normal(size=(d, d)))[0]
    matrix, passes = turn * values @ turn.T, []

    def multiply(q):
        passes.append(q.shape[1])
        assert np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-12
        return matrix @ q

    got, vectors = whitening.iterate(multiply, d, 8)
    assert len(got) == (3 if kind == "few" else 8) and np.abs(got - np.sort(values)[::-1][: len(got)]).max() < 1e-9
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-10
    assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() < 1e-8 and max(passes) == 16
