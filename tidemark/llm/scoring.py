"""Language-model scoring by Brown class bigrams.

Exchange clustering gives words classes so that the likelihood of the training text's class bigrams grows:
first the SEED most frequent words one by one, then every other word of at least LEAST occurrences, all in
SWEEPS rounds of moves on Spark, each to the class whose neighbours are the likeliest for its own (its own
counts taken out of the class it is in). The neighbours that count there are the seed's classes, all other
words, and the ends of texts. Rarer and unseen words say too little of their neighbours and belong to
classes by length and last byte. A word costs log P(class | previous class) + log P(word | class), both
smoothed by half counts. Counts and classes are kept for the whole vocabulary in a table; words too many to
broadcast (more than FREQUENT) are joined to blocks of documents. To the driver come the counts of class
pairs, of the seed's pairs, and at most FREQUENT frequent words.

Null and wordless texts are one end token; texts of any length are scored whole. An empty table gives an
empty result; without training rows all counts are 0. Repeated rows and null ids each count and get a row.
Of equally frequent words the lesser hash comes first; of equally good classes a word keeps its own, or takes
the first. Further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text, blobs
from ._spark import ready, saved, table, written
from .language import remainder

SEED, CLASSES, ROUNDS, SWEEPS = 400, 24, 3, 3
#: Occurrences in training from which a word's neighbours decide its class.
LEAST = 8
#: Words whose counts and classes are broadcast, at most; all others are joined.
FREQUENT = 1 << 18
TAIL = 32
END = CLASSES + TAIL
STATES = END + 1
#: Kinds of neighbours in clustering: the classes, any word outside the seed, the end of a text.
OTHER, STOP, KINDS = CLASSES, CLASSES + 1, CLASSES + 2
SIDES = [f"{side}{k}" for side in ("left", "right") for k in range(KINDS)]
#: Bytes of text to a block of documents.
BLOCK = 8 << 20
#: Bytes of text, or tokens, worked on at a time, and words held before they are sent on: they bound the memory of a Python worker.
CHUNK, HELD = 1 << 20, 1 << 18


def tokens(column: pa.Array):
    """Chunks of (row range, word hashes, tail classes, first word of each row)."""
    data, offsets = _text.buffer(column)
    for lo, hi in _text.chunks(offsets, CHUNK):
        d, o = _text.LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = _text.spans(~_text.SPACE[d], o)
        h = _text.hash_spans(d, starts, ends)
        tail = CLASSES + d[np.maximum(ends, 1) - 1].astype(np.int64) % 8 * 4 + np.minimum((ends - starts) // 4, 3) if len(h) else np.zeros(0, np.int64)
        yield lo, hi, h, tail, first


def held(parts):
    """Tuples of arrays, of which the parts come one by one, joined until they are HELD long together."""
    some, size = [], 0
    for part in parts:
        some.append(part)
        size += len(part[0])
        if size >= HELD:
            yield tuple(map(np.concatenate, zip(*some)))
            some, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*some)))


def vocabulary(training: DataFrame) -> DataFrame:
    """(word, tail, n) of every training word."""

    def kinds(batches):
        for b in batches:
            for _, _, h, tail, _ in tokens(b.column(0)):
                w, at, n = np.unique(h, return_index=True, return_counts=True)
                yield w, tail[at].astype(np.int32), n

    def work(batches):
        for words, tail, n in held(kinds(batches)):
            w, at, row = np.unique(words, return_index=True, return_inverse=True)
            total = np.bincount(row, n, len(w)).astype(np.int64)
            yield pa.record_batch([pa.array(w.view(np.int64)), pa.array(tail[at]), pa.array(total)], ["word", "tail", "n"])

    return training.select("text").mapInArrow(work, "word long, tail int, n long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


def lined(s: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' states in one line with an end before, between and after them, and each state's place in it."""
    rows = len(first) - 1
    line = np.full(len(s) + rows + 1, end)
    at = 1 + np.arange(len(s)) + np.repeat(np.arange(rows), np.diff(first))
    line[at] = s
    return line, at


def counted(training: DataFrame, states, size: int) -> np.ndarray:
    """A (size, size) table of neighbouring states, ends (size - 1) included; at most size**2 sums come to the driver.

    `states` gives (states, first state of each row) for a column.
    """

    def work(batches):
        for b in batches:
            total = np.zeros(size * size, np.int64)
            for s, first in states(b.column(0)):
                line, _ = lined(s, first, size - 1)
                total += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(size * size)
    for at, n in training.mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return out.reshape(size, size)


def seed_pairs(training: DataFrame, words: np.ndarray) -> np.ndarray:
    """Counts of neighbouring seed words; the last two places are any other word and the end."""

    def states(column):
        for _, _, h, _, first in tokens(column):
            yield place(h, words, len(words)), first

    return counted(training.select("text"), states, len(words) + 2)


def place(h: np.ndarray, words: np.ndarray, other: int) -> np.ndarray:
    if not len(words):
        return np.full(len(h), other)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, other)


def exchange(pairs: np.ndarray, counts: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of the words by exchange: each word in turn, most frequent first, moves where the class-bigram likelihood is greatest.

    `pairs` may have more rows and columns than words, for all other tokens; each keeps a class of its own.
    """
    m = len(counts)
    order = np.argsort(-counts, kind="stable")
    k = classes + len(pairs) - m
    cls = np.concatenate([np.zeros(m, np.int64), np.arange(classes, k)])
    cls[order] = np.arange(m) % classes

    def f(x):
        return x * np.log(np.maximum(x, 1))

    table_ = np.zeros((k, k))
    np.add.at(table_, (cls[:, None], cls[None, :]), pairs)
    for _ in range(rounds):
        moved = 0
        for w in order:
            own, loop = cls[w], pairs[w, w]
            right = np.bincount(cls, pairs[w], k)
            left = np.bincount(cls, pairs[:, w], k)
            right[own] -= loop
            left[own] -= loop
            table_[own] -= right
            table_[:, own] -= left
            table_[own, own] -= loop
            rows, columns = table_.sum(1), table_.sum(0)
            gain = np.empty(classes)
            for c in range(classes):
                row, column = table_[c] + right, table_[:, c] + left
                both = table_[c, c] + right[c] + left[c] + loop
                new = f(row).sum() - f(row[c]) + f(column).sum() - f(column[c]) + f(both)
                old = f(table_[c]).sum() + f(table_[:, c]).sum() - f(table_[c, c])
                ends = f(rows[c] + right.sum() + loop) - f(rows[c]) + f(columns[c] + left.sum() + loop) - f(columns[c])
                gain[c] = new - old - ends
            best = int(gain.argmax()) if gain.max() > gain[min(own, classes - 1)] + 1e-9 else own
            table_[best] += right
            table_[:, best] += left
            table_[best, best] += loop
            moved += best != own
            cls[w] = best
        if not moved:
            break
    return cls[:m]


def neighbours(training: DataFrame, words: np.ndarray, classes: np.ndarray, wanted) -> DataFrame:
    """(word, counts of its left and right neighbours by kind) of the words outside the seed that the broadcast bitmap lets through."""

    def sides(batches):
        for b in batches:
            for _, _, h, _, first in tokens(b.column(0)):
                at = place(h, words, -1)
                line, where = lined(np.append(classes, OTHER)[at], first, STOP)
                of = np.flatnonzero((at < 0) & blobs.maybe(h, wanted.value))
                yield h[of], line[where[of] - 1].astype(np.uint8), line[where[of] + 1].astype(np.uint8)

    def work(batches):
        for h, left, right in held(sides(batches)):
            w, row = np.unique(h, return_inverse=True)
            for lo in range(0, len(w), HELD // len(SIDES)):
                hi = min(lo + HELD // len(SIDES), len(w))
                mine = np.flatnonzero((row >= lo) & (row < hi))
                cell = (row[mine] - lo) * len(SIDES)
                total = np.bincount(cell + left[mine], minlength=(hi - lo) * len(SIDES))
                total += np.bincount(cell + KINDS + right[mine], minlength=(hi - lo) * len(SIDES))
                columns = total.reshape(-1, len(SIDES)).T
                yield pa.record_batch([pa.array(w[lo:hi].view(np.int64)), *(pa.array(np.ascontiguousarray(x)) for x in columns)], ["word", *SIDES])

    schema = ", ".join(["word long", *(f"{x} long" for x in SIDES)])
    return training.select("text").mapInArrow(work, schema).groupBy("word").agg(*(F.sum(x).alias(x) for x in SIDES))


def weights(profile: np.ndarray) -> np.ndarray:
    """The log probabilities of left and right neighbours, for rows of counts."""
    halves = profile[:, :KINDS], profile[:, KINDS:]
    return np.hstack([np.log((q + 0.5) / (q.sum(1, keepdims=True) + 0.5 * KINDS)) for q in halves])


def chosen(x: np.ndarray, profiles: list[np.ndarray]) -> np.ndarray:
    """The classes that words with neighbours `x` come to, moving once under each profile of the classes in turn."""
    own, each = None, np.arange(len(x))
    for p in profiles:
        gain = x @ weights(p).T
        best = None
        if own is not None:
            gain[each, own] = (x * weights(p[own] - x)).sum(1)
            best = gain.argmax(1)
            best = np.where(gain[each, best] > gain[each, own] + 1e-9, best, own)
        own = gain.argmax(1) if best is None else best
    return own


def counts_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(1 + k).to_numpy() for k in range(len(SIDES))]).astype(float)


def spread(around: DataFrame, seed: np.ndarray) -> DataFrame:
    """(word, class) of the words with neighbours `around`, after SWEEPS rounds that start from the seed's profile."""
    profiles = [seed]
    for _ in range(SWEEPS):
        before = list(profiles)

        def members(batches, before=before):
            for b in batches:
                x = counts_of(b)
                total = np.zeros((CLASSES, len(SIDES)), np.int64)
                np.add.at(total, chosen(x, before), x.astype(np.int64))
                yield pa.record_batch([pa.array(np.arange(CLASSES)), *(pa.array(np.ascontiguousarray(t)) for t in total.T)], ["class", *SIDES])

        schema = ", ".join(["class long", *(f"{x} long" for x in SIDES)])
        profile = seed.copy()
        for row in around.mapInArrow(members, schema).groupBy("class").agg(*(F.sum(x) for x in SIDES)).collect():  # CLASSES rows
            profile[row[0]] += np.array(row[1:], float)
        profiles.append(profile)

    def last(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(chosen(counts_of(b), profiles))], ["word", "class"])

    return around.mapInArrow(last, "word long, class long")


def clustered(training: DataFrame) -> DataFrame:
    """(word, n, state) of every training word."""
    spark = ready(training.sparkSession)
    known = saved(vocabulary(training))
    top = known.orderBy(F.desc("n"), "word").limit(SEED).collect()  # at most SEED rows
    top.sort(key=lambda r: r["word"] & (2**64 - 1))
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    pairs = seed_pairs(training, words)
    classes = exchange(pairs, np.array([r["n"] for r in top], float))
    of = np.concatenate([classes, [OTHER, STOP]])
    between = np.zeros((KINDS, KINDS))
    np.add.at(between, (of[:, None], of[None, :]), pairs)
    rest = known.filter(F.col("n") >= LEAST).select("word")
    wanted = spark.sparkContext.broadcast(blobs.bitmap(rest, rest.count()))
    around = written(neighbours(training, words, classes, wanted).join(rest, "word", "left_semi"))
    moved = spread(around, np.hstack([between[:, :CLASSES].T, between[:CLASSES]]))
    first = spark.createDataFrame([(r["word"], int(c)) for r, c in zip(top, classes)], "word long, seed long")
    state = F.coalesce("seed", "class", "tail").cast("int").alias("state")
    return written(known.join(moved, "word", "left").join(F.broadcast(first), "word", "left").select("word", "n", state))


def frequent(known: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The least count from which words are at most FREQUENT, a power of two, and those words (sorted), counts and states."""
    least, many = 1, 0
    sizes = known.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()  # at most 64 rows
    for bucket, n in sorted(sizes, reverse=True):
        many += n
        if many > FREQUENT:
            least = 1 << (bucket + 1)
            break
    got = known.filter(F.col("n") >= least).toArrow()
    return least, sorted_table(got)


def sorted_table(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = t["word"].to_numpy().view(np.uint64)
    order = np.argsort(w, kind="stable")
    return w[order], t["n"].to_numpy()[order], t["state"].to_numpy()[order]


def looked_up(h: np.ndarray, tail: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Counts and states of words by sorted tables; words in none have count 0 and their surface class."""
    n, s = np.zeros(len(h), np.int64), tail.copy()
    for words, counts, states in tables:
        at = place(h, words, -1)
        hit = np.flatnonzero(at >= 0)
        n[hit], s[hit] = counts[at[hit]], states[at[hit]]
    return n, s


def bytes_of(column: pa.Array):
    """Chunks of (states, first state of each row) of rows of state bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for lo, hi in _text.chunks(offsets, CHUNK):
        yield data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document; where `train` holds, the model learns from it."""
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    training = docs.filter("train").select("text")
    known = clustered(training)
    texts = training.count()
    mass, kinds = np.zeros(STATES), np.zeros(STATES)
    for state, total, many in known.groupBy("state").agg(F.sum("n"), F.count(F.lit(1))).collect():  # at most STATES rows
        mass[state], kinds[state] = total, many
    n, v = int(mass.sum()) + texts, int(kinds.sum()) + (texts > 0)
    room = np.log10(mass + 0.5 * (kinds + 1))
    least, common = frequent(known)
    shared = spark.sparkContext.broadcast(common)

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // BLOCK)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32(F.encode("text", "UTF-8"))), F.lit(blocks)).cast("int"))

    def rare(batches):
        for b in batches:
            block = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, h, _, first in tokens(b.column(0)):
                at = np.flatnonzero(place(h, shared.value[0], -1) < 0)
                yield h[at], np.repeat(block[lo:hi], np.diff(first))[at]

    def wanted(batches):
        for h, of in held(rare(batches)):
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            yield pa.record_batch([pa.array(of[new], pa.int32()), pa.array(h[new].view(np.int64))], ["block", "word"])

    asked = dealt.select("text", "block").repartition(blocks, "block").mapInArrow(wanted, "block int, word long")
    told = asked.join(known.filter(F.col("n") < least), "word").select("block", "word", "n", "state")

    def judge(texts_: pa.Table, told_: pa.Table) -> pa.Table:
        tables, body, out, lines = (shared.value, sorted_table(told_)), texts_["text"], [], []
        for lo, hi, h, tail, first in tokens(body):
            n_word, s = looked_up(h, tail, tables)
            rows_, many = hi - lo, np.diff(first)
            row = np.repeat(np.arange(rows_), many)
            weight = np.log10(n_word + 0.5)
            base = np.bincount(row, weight, rows_) + np.log10(texts + 0.5) - (many + 1) * np.log10(n + 0.5 * (v + 1))
            seen = np.bincount(row, n_word > 0, rows_).astype(np.int64) + (texts > 0)
            out.append((many + 1, seen, base, np.bincount(row, weight - room[s], rows_)))
            lines.append(pa.Array.from_buffers(pa.large_binary(), rows_, [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(s.astype(np.uint8))]).cast(pa.binary()))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 4
        return pa.table({"doc_id": texts_["doc_id"], "train": texts_["train"], "n_tokens": pa.array(columns[0], pa.int64()), "n_known": pa.array(columns[1], pa.int64()), "base_score": pa.array(columns[2]), "words": pa.array(columns[3]), "states": pa.chunked_array(lines, pa.binary())})

    schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, words double, states binary"
    judged = written(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(judge, schema))
    moves = counted(judged.filter("train").select("states"), bytes_of, STATES)
    step = np.log10((moves + 0.5) / (moves.sum(1, keepdims=True) + 0.5 * STATES))

    def walked(batches):
        for b in batches:
            sums = [np.zeros(0)]
            for s, first in bytes_of(b.column(5)):
                line, _ = lined(s, first, END)
                of = np.repeat(np.arange(len(first) - 1), np.diff(first) + 1)
                sums.append(np.bincount(of, step[line[:-1], line[1:]], len(first) - 1))
            total = np.concatenate(sums) + b.column(4).to_numpy()
            yield pa.record_batch([*b.columns[:3], pa.array(np.full(b.num_rows, n), pa.int64()), b.column(3), pa.array(total)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return judged.drop("train").mapInArrow(walked, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, remainder(5) != 1)
    return scored.select("doc_id", (remainder(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
