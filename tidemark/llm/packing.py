"""Best-fit packing of tokenized documents into fixed-size sequences.

Pieces of equal length are interchangeable, so packing is planned on the histogram of lengths (at most
`capacity` counts, whatever the data) and each piece finds its place from its rank among the pieces of
its length. The plan: pieces above a third of the capacity are matched greedily, at most two to a
sequence; smaller ones, longest first, go to the tightest gap.

Null text counts as empty and an empty text packs as its end token alone. Repeated rows and ids are
separate documents; ids may be null. Texts of any length are tokenized whole; pieces of equal length are
ranked by id, piece and hash, and which of equal ones comes first makes no difference. An empty table gives
no sequences. Further columns are left out.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text
from ._spark import ready, saved, table

CAPACITY = 2048
BUCKETS = 256
#: Distinct words whose ids a task remembers.
REMEMBERED = 300_000
#: Words are encoded so many at a time, with this symbol between them.
JOINED, BAR = 32, "|"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str):
    """A function from a string array to each row's ids as little-endian 32-bit bytes.

    The vocabulary lower-cases, and its normaliser and splitter never look across a space, a line end or
    the border of a letter and a full stop or comma that ends a word. So a text's ids are those of its
    parts in a row, and each distinct part of a chunk is encoded once.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model, known = Tokenizer.from_file(path), {}
    (bar,) = model.encode(BAR, add_special_tokens=False).ids  # a symbol between spaces is one id, and no other text gives it

    def learn(words: list[str]):
        nonlocal known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known, new = {}, words
        alone, joined = [w for w in new if BAR in w], [w for w in new if BAR not in w]
        known.update(zip(alone, (np.array(e.ids, "<u4").tobytes() for e in model.encode_batch_fast(alone, add_special_tokens=False))))
        groups = [joined[lo : lo + JOINED] for lo in range(0, len(joined), JOINED)]
        for lo in range(0, len(groups), 256):
            some = groups[lo : lo + 256]
            for group, e in zip(some, model.encode_batch_fast([f" {BAR} ".join(g) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cut = [-1, *np.flatnonzero(ids == bar).tolist(), len(ids)]
                known.update(zip(group, [ids[a + 1 : b].tobytes() for a, b in zip(cut, cut[1:])]))

    def encode(texts: pa.Array) -> list[bytes]:
        # the names of special tokens are matched before the lower-casing, so texts that may hold one stay as they are
        low = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        low = pc.replace_substring(low, "\n", " ")
        for mark in ".,":
            low = pc.replace_substring_regex(low, rf"([a-z])[{mark}] ", rf"\1 {mark} ")
        parts = pc.split_pattern(low, " ")
        coded = parts.values.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        learn(words)
        found = [known[w] for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, begin = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        size = sizes[codes]
        end = np.concatenate([[0], np.cumsum(size)])
        row = ids[np.repeat(begin[codes] - end[:-1], size) + np.arange(end[-1])]
        cut = end[parts.offsets.to_numpy()].tolist()
        return [row[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    return encode


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of a document's ids, of at most the capacity each."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode = encoder(path)
        for batch in batches:
            ids, texts, out = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string()).fill_null(""), []
            for lo, hi in _text.chunks(_text.buffer(texts)[1]):
                for doc, body in zip(ids[lo:hi], encode(texts.slice(lo, hi - lo))):
                    body += end
                    for k, at in enumerate(range(0, len(body), 4 * capacity)):
                        part = body[at : at + 4 * capacity]
                        out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its runs (number of pieces, first sequence, offset there, pieces to a sequence), in the order of rank."""
    left = {n: c for n, c in counts.items() if c > 0}
    runs: dict[int, list] = {n: [] for n in left}
    gaps: dict[int, list] = {}
    open_gaps = sequences = 0

    def leave(gap: int, first: int, n: int):
        nonlocal open_gaps
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))
            open_gaps |= 1 << gap

    large = sum(1 << n for n in left if 3 * n > capacity)
    for n in sorted((n for n in left if 3 * n > capacity), reverse=True):
        while left[n]:
            fits = large & ((1 << (min(n, capacity - n) + 1)) - 1)
            mate = fits.bit_length() - 1
            if mate == n and left[n] == 1:
                mate = (fits & ~(1 << n)).bit_length() - 1
            if mate < 0:
                k = left[n]
                runs[n].append((k, sequences, 0, 1))
                leave(capacity - n, sequences, k)
            elif mate == n:
                k = left[n] // 2
                runs[n].append((2 * k, sequences, 0, 2))
                leave(capacity - 2 * n, sequences, k)
                left[n] -= k
            else:
                k = min(left[n], left[mate])
                runs[n].append((k, sequences, 0, 1))
                runs[mate].append((k, sequences, n, 1))
                leave(capacity - n - mate, sequences, k)
                left[mate] -= k
                if not left[mate]:
                    large &= ~(1 << mate)
            left[n] -= k
            sequences += k
        large &= ~(1 << n)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            fits = open_gaps >> n
            if fits:
                gap = n + (fits & -fits).bit_length() - 1
                first, k = gaps[gap].pop()
                use = min(k, left[n])
                runs[n].append((use, first, capacity - gap, 1))
                left[n] -= use
                if use < k:
                    gaps[gap].append((first + use, k - use))
                if not gaps[gap]:
                    open_gaps &= ~(1 << gap)
                leave(gap - n, first, use)
            else:
                per = min(capacity // n, left[n])
                k = left[n] // per
                runs[n].append((k * per, sequences, 0, per))
                leave(capacity - per * n, sequences, k)
                left[n] -= k * per
                sequences += k
    return runs


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. `parts` is read twice, so give a saved frame."""
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    cells = parts.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = cells.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, base, at, table_ = plan(counts, capacity), {}, 0, []
    for n in sorted(runs):
        base[n] = at
        for k, first, offset, per in runs[n]:
            table_.append((at, first, offset, per))
            at += k
    lookup = np.array(table_, np.int64).reshape(-1, 4)
    bases = np.zeros(capacity + 1, np.int64)
    bases[list(base)] = list(base.values())
    shared = parts.sparkSession.sparkContext.broadcast((lookup, bases))

    def assign(batches):
        lookup, bases = shared.value
        for b in batches:
            n = b.column(3).to_numpy()
            g = bases[n] + b.column(5).to_numpy()
            start, first, offset, per = lookup[np.searchsorted(lookup[:, 0], g, "right") - 1].T
            placed = [pa.array(first + (g - start) // per), pa.array(offset + (g - start) % per * n)]
            yield pa.record_batch([*b.columns[:5], *placed], [*b.schema.names[:5], "sequence_id", "offset"])

    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = parts.withColumn("place", F.row_number().over(order) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(assign, PIECES + ", sequence_id long, offset long")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(saved(pieces(table(spark, sf_dir, "documents"), vocabulary())))
