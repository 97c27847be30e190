"""Document fingerprints by one-permutation MinHash.

The 64-bit hashes of a text's word shingles are dealt once into bins by their top bits; each bin keeps
its least hash. Empty bins copy a filled one that a random probe sequence of their own finds (optimal
densification). Only the low bits of each bin are stored; likeness subtracts chance agreement.

Null and wordless texts have the empty fingerprint: like each other (1.0), unlike all else (0.0).
Texts of any length take part whole. Repeated rows each get a row and follow one another; rows of one id are
ordered by a hash of the text; rows of a null id come last. A single row is followed by itself. An empty
table gives an empty result. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import table

BINS, BITS, WIDTH = 128, 8, 5
#: Documents to a stretch of neighbouring ids; more than MOST stretches are never made, they grow instead.
STRETCH, MOST = 4096, 4096
_PROBES = np.random.Generator(np.random.PCG64(7)).integers(0, BINS, (BINS, 256))
_BOUNDS = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - int(math.log2(BINS))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The packed low bits of the bins of sorted hashes; empty for none."""
    if not len(hashes):
        return np.zeros(0, np.uint8)
    at = np.searchsorted(hashes, _BOUNDS)
    full = np.diff(at, append=len(hashes)) > 0
    value = hashes[np.minimum(at, len(hashes) - 1)]
    source, empty, t = np.arange(BINS), np.flatnonzero(~full), 0
    while len(empty):
        probe = (_PROBES[empty, t % 256] + t // 256) % BINS
        source[empty] = probe
        empty, t = empty[~full[probe]], t + 1
    return (_text.mix(value[source]) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def signatures(texts: list[str]) -> list[np.ndarray]:
    data, offsets = _text.buffer(pa.array(texts, pa.large_string()))
    out = []
    for lo, hi in _text.chunks(offsets):
        h, first = _text.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        out += [signature(s) for s in _text.shingles(h, first, WIDTH)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated Jaccard similarity, with the agreement of unequal bins by chance taken out."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (np.mean(a == b) - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n] if n else text


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, text, stretch, lent): documents dealt into stretches of ids, each followed by a lent copy of the first document of the next stretch.

    Within partitions rows are in falling order of id. Null ids come last.
    """
    from pyspark.ml.feature import Bucketizer

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = docs.withColumn("ord", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("place", F.col("ord").cast("double"))
    n = min(MOST, 1 + docs.select("doc_id").count() // STRETCH)
    cuts = sorted(set(ordered.approxQuantile("place", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    deal = Bucketizer(splits=[-math.inf, *(cuts or [0.0]), math.inf], inputCol="place", outputCol="stretch").transform
    dealt = deal(ordered).withColumn("stretch", F.col("stretch").cast("int")).drop("place")
    heads = [(r[0], r[1]) for r in dealt.groupBy("stretch").agg(F.max("ord")).orderBy("stretch").collect()]  # at most MOST rows
    ring = docs.sparkSession.createDataFrame([(head, heads[(i + 1) % len(heads)][0]) for i, (_, head) in enumerate(heads)], "ord long, to int")
    lent = dealt.join(F.broadcast(ring), "ord").select("doc_id", "text", "ord", F.col("to").alias("stretch"), F.lit(1).alias("lent"))
    all_rows = dealt.select("doc_id", "text", "ord", "stretch", F.lit(0).alias("lent")).unionByName(lent)
    width = max(len(heads), 1)
    return all_rows.repartition(width, "stretch").sortWithinPartitions("stretch", "lent", F.desc("ord"), F.xxhash64("text"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document, and their likenesses."""

    def work(batches):
        held = None
        for rows in (list(zip(*(c.to_pylist() for c in part.columns))) for part in _text.portions(batches, 1)):
            if held is not None:
                rows.insert(0, held)
            out = []
            for lo in range(0, max(len(rows) - 1, 0), 512):
                part = rows[lo : lo + 513]
                own = signatures([r[1] for r in part])
                pairs = [(i, edited(a[1], b[1])) for i, (a, b) in enumerate(zip(part, part[1:])) if a[2] == b[2] and not a[3]]
                for (i, text), other in zip(pairs, signatures([t for _, t in pairs])):
                    out.append((part[i][0], len(part[i][1]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), own[i].tobytes().hex(), other.tobytes().hex(), likeness(own[i], other), likeness(own[i], own[i + 1])))
            held = rows[-1] if rows else held
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], RESULT.replace(",", "").split()[::2])

    return neighbours(docs).select("doc_id", "text", "stretch", "lent").mapInArrow(work, RESULT)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
