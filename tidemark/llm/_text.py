"""Vectorised helpers over the UTF-8 buffers of Arrow string columns: words, their hashes and shingles.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D, after A-Z are lowered, so that
multi-byte characters always belong to words. Nothing here touches Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the memory of the 64-bit temporaries.
BLOCK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that every bit depends on all of them."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 4 << 20):
    """Ranges of rows of at most so many bytes each, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def portions(batches, column: int):
    """Arrow batches cut to rows of about 4 MB of text each, so that no task holds a whole batch several times over."""
    for batch in batches:
        for lo, hi in chunks(buffer(batch.column(column))[1]):
            yield batch.slice(lo, hi - lo)


def spans(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross rows, and each row's first run (one more entry than rows)."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Spans must be sorted and must not overlap."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = _power(max(BLOCK, b - a) + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTES[data[a:b]] * up[: b - a], out=sums[1:])
        s = starts[lo:hi] - a
        out[lo:hi] = (sums[ends[lo:hi] - a] - sums[s]) * down[s]
        lo = hi
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and each row's first word (one more entry than rows)."""
    low = LOWER[data]
    starts, ends, first = spans(~SPACE[data], offsets)
    return hash_spans(low, starts, ends), first


def shingles(h: np.ndarray, first: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the hashes of its runs of so many words, sorted and distinct; of the whole sequence if it is shorter; none without words."""
    n = len(h)
    rolled = h[: max(0, n - width + 1)].copy()
    for k in range(1, width):
        rolled = rolled * _ODD + h[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = h[a]
            with np.errstate(over="ignore"):
                for x in h[a + 1 : b]:
                    whole = whole * _ODD + x
                out.append(mix(np.array([whole + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def lower_ascii(text: str) -> str:
    """A-Z lowered, all else as it is."""
    return text.translate(_TABLE)


_TABLE = {i: i + 32 for i in range(65, 91)}
