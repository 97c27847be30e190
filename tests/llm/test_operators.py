"""Each registered query against a brute-force version, on hard rows and on the smallest table."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tests_brute import brute_components, brute_set

from tidemark.llm import decontamination, fingerprints, jaccard, language, packing, queries, secrets, sharding


def rows(spark, folder, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]


def texts(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    model, want = Tokenizer.from_file(packing.vocabulary()), {}
    for d, t in texts(spark, folder).items():
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d, k] = (at, len(part), zlib.crc32(part.tobytes()))
    got = rows(spark, folder, "op1_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.03 * -(-sum(r["length"] for r in got) // 2048) + 1


def test_plan_places_every_piece_once():
    r = np.random.default_rng(3)
    counts = {int(n): int(c) for n, c in zip(r.integers(1, 101, 60), r.integers(1, 50, 60))}
    runs, filled = packing.plan(counts, 100), defaultdict(list)
    for n, parts in runs.items():
        assert sum(k for k, *_ in parts) == counts[n]
        for k, first, offset, per in parts:
            for g in range(k):
                filled[first + g // per].append((offset + g % per * n, n))
    for places in filled.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 100 and sum(3 * n > 100 for _, n in places) <= 2


def test_fingerprints(spark, folder):
    all_texts = texts(spark, folder)
    order, got = sorted(all_texts, reverse=True), {r["doc_id"]: r for r in rows(spark, folder, "op3_fingerprints")}
    assert set(got) == set(order)
    for d, following in zip(order, order[1:] + order[:1]):
        t, u, r = all_texts[d] or "", all_texts[following] or "", got[d]
        n = len(t) // 2
        changed = t[: len(t) - n] + u[:n]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b = brute_set(t), brute_set(changed)
        if a and b:
            assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 0.25
    assert got[order[0]]["fingerprint"] == fingerprints.signatures([all_texts[order[0]] or ""])[0].tobytes().hex()


def test_jaccard(spark, folder):
    sets = {d: brute_set(t) for d, t in texts(spark, folder).items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, folder, "op4_jaccard")}
    want = brute_components(sets)
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}


def test_jaccard_large_regions(spark):
    """Near copies in chains, unrelated texts with a shared passage, and repeated copies."""
    r, made = np.random.default_rng(1), {}
    base = [f"b{i}" for i in range(60)]
    for k in range(150):
        w = list(base)
        for at in r.integers(0, 60, r.integers(0, 4)):
            w[at] = f"c{r.integers(0, 40)}"
        made[k] = " ".join(w)
    for k in range(60):
        made[1000 + k] = " ".join(base[:30] + [f"d{k}_{i}" for i in range(r.integers(1, 30))])
    frame = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in jaccard.linked(frame).collect()}
    assert got == brute_components({d: brute_set(t) for d, t in made.items()})


def test_secrets(spark, folder):
    names = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
    got = {r["doc_id"]: r for r in rows(spark, folder, "op5_secrets")}
    for d, t in texts(spark, folder).items():
        t, found = t or "", []
        found += [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        joined = [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(f[1] == i for f in found) for i in range(3)]
        every = [f"{k}:{a}:{b}" for k, a, b in full_scan(t)]
        assert got[d]["spans"] == ",".join(every) and set(joined) <= set(every)


def full_scan(text):
    found = [(m.start(), i, r.kind, m.end()) for i, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, text) if r.keep(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") is None
    assert [["aki"], ["kia"]] == secrets.trigram_query("AKIA[A-Z0-9]+")[0]
    assert secrets.redact("x secret=abcdef y", [("assign", 2, 15)]) == "x [assign] y"


def test_decontamination(spark, folder):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = word.findall((r["text"] or "").encode().lower())
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(r["item_id"]))
    got = {r["doc_id"]: r for r in rows(spark, folder, "op6_decontamination")}
    for d, t in texts(spark, folder).items():
        w, hit, items = word.findall((t or "").encode().lower()), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_decontamination_in_slices_with_spans(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {r["doc_id"]: r for r in decontamination.scan(docs, bench).collect()}
    many = {r["doc_id"]: r for r in decontamination.scan(docs, bench, most=5).collect()}
    assert one == many
    assert [tuple(s) for s in one[5]["spans"]] == [(0, 8)]


def test_sharding(spark, folder):
    got, all_texts = rows(spark, folder, "op7_sharding"), texts(spark, folder)
    shards = defaultdict(list)
    for r in got:
        t = (all_texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        shards[r["shard"]].append(r)
    assert len(got) == len(all_texts) and set(shards) <= set(range(24))
    for s in shards.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    sizes = [sum(r["size"] for r in shards[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= max(r["size"] for r in got)


def test_rebalancing_edits_the_map(spark):
    rows_ = sharding.sized(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    stats = sharding.slot_bytes(rows_)
    first = sharding.slot_map(stats, 4)
    grown = sharding.rebalance(first, stats, 5)
    a, b = ({r["virtual_slot"]: r["shard"] for r in m.collect()} for m in (first, grown))
    moved = [v for v in a if a[v] != b[v]]
    assert moved and len(moved) < len(a) / 2 and grown.first()["version"] == 2


def test_quality(spark, folder):
    got = rows(spark, folder, "op8_quality")
    assert len(got) == len(texts(spark, folder))
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    tested = [r for r in rows(spark, d, "op8_quality") if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in tested]) > 0.93


def test_language(spark, folder):
    all_texts = texts(spark, folder)
    got = {r["doc_id"]: r for r in rows(spark, folder, "op9_language")}
    assert set(got) == set(all_texts)
    for d, t in all_texts.items():
        assert (got[d]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[d]["score"] <= 1


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    tested = [r for r in rows(spark, d, "op9_language") if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in tested]) > 0.97


def test_gradients_against_differences():
    net = language.Network(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.array([[5, 6, 256], [7, 8, 9]]).T, np.array([0, 1])
    _, g = net.gradients(np.ascontiguousarray(x), y)
    for k, at in (("x", (0, 6, 2)), ("x", (1, 8, 7)), ("u", (0, 1, 4)), ("u", (1, 2, 0)), ("o", (4, 1)), ("b", (0,))):
        kept, loss = net.p[k][at], []
        for step in (1e-2, -1e-2):
            net.p[k][at] = kept + step
            loss.append(net.gradients(np.ascontiguousarray(x), y)[0])
        net.p[k][at] = kept
        assert abs((loss[0] - loss[1]) / 2e-2 - g[k][at]) < 2e-3


def test_suffixes(spark, folder):
    raw = {d: (t or "").encode() for d, t in texts(spark, folder).items()}
    least = {}
    for d in sorted(raw):
        for i in range(len(raw[d]) - 49):
            least.setdefault(raw[d][i : i + 50], d)
    for r in rows(spark, folder, "op10_suffixes"):
        t, gone = raw[r["doc_id"]], set()
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < r["doc_id"]:
                gone.update(range(i, i + 50))
        kept = bytes(c for i, c in enumerate(t) if i not in gone)
        spans = sum(i - 1 not in gone for i in gone)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(t), len(gone), spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_suffix_array_against_sorting():
    from tidemark.llm import suffixes

    data = np.random.default_rng(2).integers(0, 3, 400).astype(np.uint8)
    order, _ = suffixes.suffix_array(data, 512)
    assert order.tolist() == sorted(range(400), key=lambda i: data[i:].tobytes())


def test_scoring(spark, folder):
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None] for d, t in texts(spark, folder).items()}
    counts = defaultdict(int)
    for d, w in words.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            for x in w:
                counts[x] += 1
    total, kinds = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in rows(spark, folder, "op2_scoring")}
    assert set(got) == set(words)
    for d, w in words.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert abs(r["base_score"] - sum(np.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)) < 1e-6 * len(w)
        assert r["score"] < 0


def test_scores_against_classes_and_counts(spark, folder):
    from pyspark.sql import functions as F

    from tidemark.llm import scoring
    from tidemark.llm.language import remainder

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = {r["word"]: r for r in scoring.clustered(docs.filter(remainder(5) != 1)).collect()}
    assert any(r["state"] < scoring.CLASSES for r in known.values())
    lines = []
    for r in docs.select("doc_id", "text", F.coalesce(remainder(5) != 1, F.lit(False)).alias("train")).collect():
        [(_, _, h, tail, _)] = scoring.tokens(pa.array([r["text"]], pa.string()))
        words = [known.get(int(x), {"n": 0, "state": int(t)}) for x, t in zip(h.view(np.int64), tail)]
        lines.append((r["doc_id"], r["train"], [(w["n"], w["state"]) for w in words]))
    moves, total, kinds = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in known.values():
        total[r["state"]] += r["n"]
        kinds[r["state"]] += 1
    for _, train, line in lines:
        states = [scoring.END, *(s for _, s in line), scoring.END]
        for pair in zip(states, states[1:]) if train else ():
            moves[pair] += 1
    out = defaultdict(int)
    for (a, _), n in moves.items():
        out[a] += n
    expected = defaultdict(list)
    for d, _, line in lines:
        states = [scoring.END, *(s for _, s in line), scoring.END]
        value = sum(np.log10((moves[p] + 0.5) / (out[p[0]] + 0.5 * scoring.STATES)) for p in zip(states, states[1:]))
        expected[d].append(value + sum(np.log10((n + 0.5) / (total[s] + 0.5 * (kinds[s] + 1))) for n, s in line))
    got = defaultdict(list)
    for r in rows(spark, folder, "op2_scoring"):
        got[r["doc_id"]].append(r["score"])
    assert set(got) == set(expected)
    for d in got:
        assert np.allclose(sorted(got[d]), sorted(expected[d]), rtol=1e-9)


def test_words_move_to_the_class_with_their_neighbours():
    from tidemark.llm import scoring

    profile = np.zeros((scoring.CLASSES, 2 * scoring.KINDS))
    profile[3, 5], profile[7, 9] = 100, 100
    x = np.zeros((3, 2 * scoring.KINDS))
    x[0, 5], x[1, 9], x[2, 5] = 4, 4, 1
    assert scoring.chosen(x, [profile]).tolist() == [3, 7, 3]
    later = profile.copy()
    later[3] += x[0] + x[2]
    later[7] += x[1]
    assert scoring.chosen(x, [profile, later]).tolist() == [3, 7, 3]


def test_frequent_words_are_bounded(spark, folder, monkeypatch):
    """Few broadcast words, the rest joined: the scores are the same."""
    from tidemark.llm import scoring

    one = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in rows(spark, folder, "op2_scoring"))
    monkeypatch.setattr(scoring, "FREQUENT", 3)
    assert one == sorted((str(r["doc_id"]), round(r["score"], 6)) for r in rows(spark, folder, "op2_scoring"))


def test_class_model_beats_unigrams_on_held_out_text(spark):
    tested = [r for r in rows(spark, "/root/testdata/sf0.01", "op2_scoring") if r["held_out"]]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)


class _Taken:
    """Stands for a DataFrame: keeps the functions that are given to mapInArrow."""

    def __init__(self):
        self.functions = []

    def mapInArrow(self, work, schema):
        self.functions.append(work)
        return self

    def __getattr__(self, name):
        return lambda *a, **k: self


def test_scoring_workers_hold_little_at_a_time(monkeypatch):
    """12 MB of text of 300,000 different words: memory follows the chunks and not the text, and cuts change no count."""
    import tracemalloc

    from tidemark.llm import scoring

    monkeypatch.setattr(scoring, "F", _Taken())
    rng = np.random.default_rng(4)
    texts_ = [" ".join(map(str, rng.integers(0, 300_000, 300))) for _ in range(6000)]
    batch = pa.record_batch([pa.array(texts_, pa.string())], ["text"])
    seed = np.unique(np.concatenate([h for _, _, h, _, _ in scoring.tokens(pa.array(texts_[:1]))]))

    class Every:
        value = (12, np.full(64, 2**64 - 1, np.uint64))

    def sums(*sizes):
        for name, size in zip(("CHUNK", "HELD"), sizes):
            monkeypatch.setattr(scoring, name, size, raising=False)
        taken = _Taken()
        scoring.vocabulary(taken)
        scoring.neighbours(taken, seed, np.arange(len(seed)) % scoring.CLASSES, Every)
        found = []
        for work, kept in zip(taken.functions, (["n"], scoring.SIDES)):
            tracemalloc.start()
            total = defaultdict(int)
            peak = 0
            for out in work(iter([batch])):
                peak = max(peak, tracemalloc.get_traced_memory()[1])
                tracemalloc.stop()
                mass = np.column_stack([out[c].to_numpy() for c in kept]) @ np.arange(1, len(kept) + 1)
                for w, n in zip(out["word"].to_pylist(), mass.tolist()):
                    total[w] += n
                tracemalloc.start()
            tracemalloc.stop()
            found.append((total, peak))
        return found

    little, whole = sums(1 << 20, 1 << 18), sums(1 << 30, 1 << 30)
    for (counts, peak), (same, more) in zip(little, whole):
        assert counts == same and len(counts) > 250_000
        assert peak < 60e6 < more  # 41 and 32 MB
