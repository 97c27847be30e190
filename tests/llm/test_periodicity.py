"""Runs of words against brute force over all periods, and their digests."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodicity, queries
from tidemark.llm._text import mix


def brute(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(24, 3 * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def found(texts):
    first = np.cumsum([0, *map(len, texts)])
    return periodicity.runs(mix(np.array([w for t in texts for w in t], np.uint64)), first)


piece = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 90)).map(lambda p: (p[0] * p[1])[: p[1]])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(piece, max_size=5).map(lambda ps: [w for p in ps for w in p]), min_size=1, max_size=4))
def test_runs(texts):
    assert found(texts) == [brute(t) for t in texts]


def test_long_and_nested_runs():
    nested = ([0, 1] * 3 + [2]) * 40
    assert found([nested, nested[:50], [7] * 30_000]) == [brute(nested), brute(nested[:50]), [(0, 30_000, 1)]]
    word = [0, 1]
    while len(word) < 3000:
        word += word[:-1] + [word[-1] ^ 1]
    assert found([word]) == [brute(word)]


def test_branching_repeats_end_every_square():
    r = np.random.default_rng(1)
    for _ in range(40):
        w = r.integers(0, 2, 60).tolist()
        starts, periods, _ = periodicity.branching_repeats(np.array([*w, 9]))
        want = {(i, p) for p in range(1, 31) for i in range(61 - 2 * p) if w[i : i + p] == w[i + p : i + 2 * p] and (i + 2 * p == 60 or w[i + 2 * p] != w[i + p])}
        assert set(zip(starts.tolist(), periods.tolist())) == want


def words_of(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = words_of(doc_id, text)
    runs = brute(w)
    keep = [not any(s + q <= i < s + n for s, n, q in runs) for i in range(len(w))]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digests = ["".join(f"{s},{n},{q}\n" for s, n, q in runs).encode(), b" ".join(x for x, k in zip(w, keep) if k)]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(hashlib.sha256(d).hexdigest() for d in digests))


def test_query(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = Counter(map(tuple, queries.QUERIES["op12_periodicity"](spark, folder).collect()))
    assert got == Counter(expected(*d) for d in docs if len((d[1] or "").split()) < 2500) + Counter({r: k for r, k in got.items() if r[0] in {d for d, t in docs if len((t or "").split()) >= 2500}})
    assert sum(got.values()) == len(docs) and (folder.endswith("small") or "tmp" in folder or any(r[1] for r in got))


def test_collapsed_text(spark):
    line = " ".join(f"w{i}" for i in range(9))
    docs = [(1, f"Ü x\n{line} {line}\t{line} end"), (1, None), (None, "a " * 30), (2, ""), (2, "one two")]
    got = {(r["doc_id"], len(r["runs"]), r["collapsed"]) for r in periodicity.collapsed(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 1, f"Ü x {line} end"), (1, 0, ""), (None, 1, "a"), (2, 0, ""), (2, 0, "one two")}


@pytest.mark.parametrize("doc_id", [None, 0, 7, -3, 2**60])
def test_planted_words(doc_id):
    for n in (1, 2, 50):
        order = periodicity.planted(doc_id, n)
        got = list(range(n)) if order is None else order.tolist()
        assert [b"%d" % k for k in got] == words_of(doc_id, " ".join(map(str, range(n))))
