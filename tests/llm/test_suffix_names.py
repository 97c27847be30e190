"""Names of runs, their bitmap, names of very many places and copies of whole texts, each against brute force."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import suffixes
from tidemark.llm.blobs import maybe, wide_bitmap


def test_names_are_spread_evenly():
    """A bitmap and the parts go by a name's upper bits: with least hashes themselves, 1/28 of the greatest on average, most names met in few slots."""
    data = np.random.default_rng(1).integers(97, 123, 200_000).astype(np.uint8)
    name = suffixes.runs(data, np.array([0, len(data)]))[2]
    assert len(name) > 10_000 and 0.48 < np.mean(name / 2.0**64) < 0.52


def test_wide_bitmap(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63, 40_000)
    has = wide_bitmap(spark.createDataFrame([(int(k),) for k in keys[:20_000]], "k long"), 20_000)
    through = maybe(keys.view(np.uint64), has)
    assert through[:20_000].all() and through[20_000:].mean() < 0.08


@pytest.mark.parametrize("depth", [1, 7, 10, 50])
def test_suffixes_at_chosen_places_against_sorting(depth):
    data = np.random.default_rng(3).integers(0, 2, 600).astype(np.uint8)
    starts = np.flatnonzero(np.arange(600) % 3 != 1)
    order, group = suffixes.suffix_array(data, depth, starts)
    heads = [data[i : i + depth].tobytes() for i in order]
    assert sorted(order) == starts.tolist() and heads == sorted(heads)
    assert [heads[i] == heads[i - 1] for i in range(1, len(heads))] == (group[1:] == group[:-1]).tolist()


def test_least_owner_against_every_run():
    r = np.random.default_rng(4)
    pool = [r.integers(97, 100, 30).astype(np.uint8).tobytes() for _ in range(4)]
    segments = [b"".join(pool[k] for k in r.integers(0, 4, r.integers(2, 5))) for _ in range(40)]
    owner = r.permutation(40)
    least = {}
    for s, o in zip(segments, owner):
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(o, least.get(s[i : i + 50], o))
    got = {}
    for of, first, end, low in zip(*suffixes.least_owner(segments, owner)):
        got |= {(of, i): low for i in range(first, end)}
    assert got == {(k, i): least[s[i : i + 50]] for k, s in enumerate(segments) for i in range(len(s) - 49)}


@pytest.mark.parametrize("hot", [suffixes.HOT, 3])
def test_common_passages_and_copies(spark, tmp_path, monkeypatch, hot):
    """With a low bound most names are hot: summed up first, waiting for it, and salted."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "HEAVY", min(hot, suffixes.HEAVY))
    r = np.random.default_rng(5)
    word = lambda n: "".join(r.choice(list("abcdé "), n))
    passages = [word(80) for _ in range(4)]
    rows = [(i, "".join(passages[k][x : x + 70] + word(int(r.integers(0, 60))) for k, x in zip(r.integers(0, 4, 3), r.integers(0, 12, 3)))) for i in r.permutation(60).tolist()]
    rows += [(i, rows[i % 7][1]) for i in (3, 100, -1, 101, 102)]  # copies before and after
    rows += [rows[5], rows[5], (rows[6][0], rows[7][1]), (None, rows[8][1]), (200, None), (201, word(49)), (202, word(50)), (203, "x" * 300), (204, "x" * 50), (205, "x" * 49)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    least, want = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49) if d is not None else ():
            least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], d))
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - 49) if d is not None else ():
            if least[b[i : i + 50]] < d:
                gone.update(range(i, i + 50))
        kept = bytes(c for i, c in enumerate(b) if i not in gone)
        want.append((d, len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest(), kept))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    whole = [(*r[:5], bytes(r[5])) for r in suffixes.without_repeats(docs).collect()]
    digests = [tuple(r) for r in suffixes.op10_suffixes(spark, str(tmp_path)).collect()]
    assert sorted(whole, key=str) == sorted(want, key=str) and sorted(digests, key=str) == sorted((w[:5] for w in want), key=str)
