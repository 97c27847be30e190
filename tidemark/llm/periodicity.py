"""Periodic runs of words by the suffix tree of Stoye and Gusfield.

A run is a stretch of words with smallest period q and length >= max(24, 3 * q) that no neighbouring word extends.
Such a run is covered by 16-word grams that repeat within its document: its copy q words further on overlaps
it in 16 words or more. So the covered stretches of a batch of texts hold all runs, and their symbols, numbered for
each stretch, form one forest of suffix trees: suffixes are sorted by doubling prefixes, common prefixes come from
the ranks of all powers of two, and internal nodes are the intervals of equal prefixes. For every node of depth D
the leaf lists of all children but the largest are traversed; a leaf i whose partner i + D or i - D is in the node,
but in another child, starts or ends a branching tandem repeat of period D. Every run ends in one: rotating it to
the left by the same ranks gives the run's start, and repeats of one stretch merge under their least period.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, in their case; equal 64-bit hashes count as equal words.
Null and empty texts have no words, no runs and the digest of nothing. Repeated rows and null ids each get a row (a
null id changes no words in `op12_periodicity`). Of runs of one exponent the least start counts, then the least period.
Texts are read whole; a task holds about 4 MB of texts, or one longer text, and its ranks. An empty table gives an
empty result; further columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import ready, table

LEAST, TIMES, GRAM = 24, 3, 16
Run = tuple[int, int, int]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def repeated_stretches(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what 16-word grams cover that occur at least twice in one text."""
    m = len(words) - GRAM + 1
    if m < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram, width = words.copy(), 1
    while width < GRAM:  # grams of twice the width from those of the width
        gram = gram[: len(gram) - width] * _STEP + _text.mix(gram[width:])
        width *= 2
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:m] == row[GRAM - 1 :])
    key = _text.mix(gram[at] + row[at].astype(np.uint64) * _STEP)
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    at = at[twice[spot] == key]
    fresh = np.flatnonzero((np.diff(at, prepend=at[0] - GRAM - 1) > GRAM) | (row[at] != np.concatenate([[-1], row[at[:-1]]])))
    return at[fresh], np.append(at[fresh[1:] - 1], at[-1]) + GRAM


def ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """For each power of two the ranks of the prefixes of that length, until all differ. No two suffixes may be equal."""
    out, n, width = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)], len(symbols), 1
    while len(out[-1]) and out[-1].max() + 1 < n:
        r = out[-1]
        second = np.zeros(n, np.int64)
        second[: n - width] = r[width:] + 1
        out.append(np.unique(r * (n + 1) + second, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return out


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """The length of the common prefix of the suffixes at a and b; back: of the common suffix of what ends before them.

    Two different suffixes share less than twice the highest power of two among the levels.
    """
    a, b, n = a.copy(), b.copy(), len(levels[0])
    from_ = a.copy()
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        x, y = (a - step, b - step) if back else (a, b)
        fits = (np.minimum(x, y) >= 0) & (np.maximum(x, y) + step <= n)
        same = fits & (levels[k][np.where(fits, x, 0)] == levels[k][np.where(fits, y, 0)])
        move = np.where(same, -step if back else step, 0)
        a, b = a + move, b + move
    return np.abs(a - from_)


def branching_repeats(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and periods of all branching tandem repeats of a forest whose trees end in symbols of their own, and its ranks."""
    levels = ranks(symbols)
    n = len(symbols)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    place = levels[-1]
    shared = np.zeros(n, np.int64)  # with the suffix before
    shared[1:] = common(levels, order[:-1], order[1:])
    left = _smaller_before(shared)
    right = n - 1 - _smaller_before(shared[::-1])[::-1]  # the place after the interval
    inner = np.flatnonzero(shared > 0)
    first, last, depth = left[inner], right[inner] - 1, shared[inner]
    by = np.lexsort((inner, last, first))
    inner, first, last, depth = inner[by], first[by], last[by], depth[by]
    starts, periods = [], []
    if len(inner):
        new = np.append(True, (first[1:] != first[:-1]) | (last[1:] != last[:-1]))
        head = np.flatnonzero(new)
        # children of a node: from its first suffix to its first place of that depth, on to the next, up to its last suffix
        child_first = np.concatenate([first[head], inner])
        child_node = np.concatenate([np.arange(len(head)), np.cumsum(new) - 1])
        by = np.lexsort((child_first, child_node))
        child_first, child_node = child_first[by], child_node[by]
        closing = np.append(child_node[1:] != child_node[:-1], True)
        child_end = np.where(closing, last[head][child_node] + 1, np.append(child_first[1:], 0))
        size = child_end - child_first
        edge = np.flatnonzero(np.append(True, child_node[1:] != child_node[:-1]))
        largest = np.maximum.reduceat(size, edge)[child_node]
        top = np.flatnonzero(size == largest)
        keep = np.ones(len(size), bool)
        keep[top[np.unique(child_node[top], return_index=True)[1]]] = False  # one largest child of each node
        small = np.flatnonzero(keep)
        for block in _blocks(size[small], 1 << 20):
            c = small[block]
            child = np.repeat(c, size[c])
            leaf = order[np.repeat(child_first[c], size[c]) + np.arange(len(child)) - np.repeat(np.cumsum(size[c]) - size[c], size[c])]
            node = head[child_node[child]]
            d, lo, hi, own_lo, own_hi = depth[node], first[node], last[node], child_first[child], child_end[child]
            for partner, start in ((leaf + d, leaf), (leaf - d, leaf - d)):
                inside = (partner >= 0) & (partner < n)
                at = place[np.where(inside, partner, 0)]
                hit = inside & (at >= lo) & (at <= hi) & ((at < own_lo) | (at >= own_hi))
                starts.append(start[hit])
                periods.append(d[hit])
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *periods]), levels


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """The nearest place before each with a smaller value, 0 at least."""
    n = len(values)
    to = np.arange(-1, n - 1)
    low = np.append(values, -1)  # place -1 is smaller than all
    open_ = np.arange(n)
    while len(open_ := open_[low[to[open_]] >= values[open_]]):
        to[open_] = to[to[open_]]
    return np.maximum(to, 0)


def _blocks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about so many in sum, or of one larger."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


def runs(words: np.ndarray, first: np.ndarray) -> list[list[Run]]:
    """For each text its runs as (start, length, period), by start and period. words: hashes; first: each text's first word."""
    out: list[list[Run]] = [[] for _ in range(len(first) - 1)]
    starts, ends = repeated_stretches(words, first)
    for block in _blocks(ends - starts, 1 << 20):
        for text, start, length, period in _forest_runs(words, starts[block], ends[block], first):
            out[text].append((start, length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _forest_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    size = ends - starts
    if not len(size):
        return
    offset = np.cumsum(size + 1) - size - 1
    tree = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(tree)) + tree
    symbols = np.empty(len(tree) + len(size), np.int64)
    named = np.unique(words[np.repeat(starts - offset, size) + at], return_inverse=True)[1]
    symbols[at] = tree * (named.max() + 1) + named
    symbols[offset + size] = len(size) * (named.max() + 1) + np.arange(len(size))
    where, period, levels = branching_repeats(symbols)
    if not len(where):
        return
    rotated = where - common(levels, where, where + period, back=True)
    length = where + 2 * period - rotated
    fine = np.flatnonzero(length >= np.maximum(LEAST, TIMES * period))
    rotated, length, period = rotated[fine], length[fine], period[fine]
    by = np.lexsort((period, length, rotated))
    rotated, length, period = rotated[by], length[by], period[by]
    new = np.append(True, (rotated[1:] != rotated[:-1]) | (length[1:] != length[:-1]))[: len(by)]
    in_tree = np.searchsorted(offset, rotated, "right") - 1
    real = starts[in_tree] + rotated - offset[in_tree]
    text = np.searchsorted(first, real, "right") - 1
    yield from zip(*(v[new].tolist() for v in (text, real - first[text], length, period)))


def kept(n: int, found: list[Run]) -> np.ndarray:
    """True for the words that no run repeats."""
    keep = np.ones(n, bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return keep


def scan(column: pa.Array, changed: Callable[[int, int], np.ndarray | None] | None = None) -> Iterator[tuple[list[Run], bytes]]:
    """For each text its runs and its other words joined by one space. changed: for a row and its number of words the numbers of the words to read instead."""
    data, offsets = _text.buffer(column)
    starts, ends, first = _text.spans(~_text.SPACE[data], offsets)
    words = _text.hash_spans(data, starts, ends)
    instead = {}
    for i, n in enumerate(np.diff(first).tolist() if changed else ()):
        if n and (order := changed(i, n)) is not None:
            words[first[i] : first[i + 1]] = words[first[i] + order]
            instead[i] = order
    raw = data.tobytes()
    for i, found in enumerate(runs(words, first)):
        text = raw[offsets[i] : offsets[i + 1]].split()
        if i in instead:
            text = [text[k] for k in instead[i].tolist()]
        if found:
            text = [text[k] for k in np.flatnonzero(kept(len(text), found)).tolist()]
        yield found, b" ".join(text)


RUNS = "array<struct<start:long,length:long,period:long>>"


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id, runs, and the text with every run cut to its first period."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(batches):
        for b in _text.portions(batches, 1):
            found, texts = zip(*scan(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], kind), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "runs", "collapsed"])

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, f"doc_id long, runs {RUNS}, collapsed string")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The words that `op12_periodicity` reads of a document of n words, where they are not its own."""
    if doc_id is None:
        return None
    g, h = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if h:
        return None
    a, i = g % n, np.arange(n)
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


def op12_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def work(batches):
        for b in _text.portions(batches, 1):
            ids, rows = b.column(0).to_pylist(), []
            for found, text in scan(b.column(1), lambda i, n: planted(ids[i], n)):
                best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
                digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
                rows.append((len(found), *best, 1000 * best[1] // best[2] if found else None, digest, hashlib.sha256(text).hexdigest()))
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()] * 2))], names)

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(work, ", ".join(f"{c} {'string' if 'sha' in c else 'long'}" for c in names))
