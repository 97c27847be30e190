"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark.

Words are runs of letters, digits and non-ASCII characters after A-Z are lowered. Every run of `width`
words of an item (the whole item if it has fewer) is a pattern, bounded by spaces; each text is
normalised once, scanned once, and hits are mapped back to words and to code points of the original.

Null and wordless texts have no words and are clean; null and wordless items have no patterns; equal
patterns of several items count for each of them; an empty benchmark leaves all documents clean.
Repeated document rows and null ids each get a row; texts of any length are scanned whole; further columns
are left out of scans and kept by `clean`.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import ready, table

WIDTH = 10
#: Patterns in one automaton, which bounds its memory; a larger benchmark has several automata.
MOST_PATTERNS = 200_000
#: Characters scanned with one of several automata before the next is built.
GROUP = 32_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HITS = "doc_id long, n_words long, hit_words array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def patterns(items: list[tuple[object, str | None]], width: int = WIDTH) -> dict[str, list[str]]:
    out: dict[str, set[str]] = {}
    for item, text in items:
        w = [x.decode() for x in normalised(text)]
        for i in range(max(1, len(w) - width + 1) if w else 0):
            out.setdefault(" " + " ".join(w[i : i + width]) + " ", set()).add(str(item))
    return {k: sorted(v) for k, v in out.items()}


def _machine(items: list[tuple[object, str | None]], width: int):
    import ahocorasick

    found = patterns(items, width)
    if not found:
        return None
    machine = ahocorasick.Automaton()
    for k, names in found.items():
        machine.add_word(k, (k.count(" ") - 1, names))
    machine.make_automaton()
    return machine


def _hits(words: list[bytes], machine, hit: set[int], items: set[str]) -> None:
    """Adds the words hit and the items found by one automaton."""
    line = f" {b' '.join(words).decode()} "
    at = word = 0
    for end, (n, names) in machine.iter(line):
        word += line.count(" ", at, end + 1)  # the space that closes the pattern is the word'th one
        at = end + 1
        hit.update(range(word - 1 - n, word - 1))
        items.update(names)


def _spans(text: str, hit: set[int]) -> list[tuple[int, int]]:
    raw = text.encode("utf-8", "surrogatepass")
    found = [m.span() for m in _WORD.finditer(raw.lower())]
    spans: list[tuple[int, int]] = []
    for w in sorted(hit):
        a, b = (len(raw[:x].decode("utf-8", "surrogatepass")) for x in found[w])
        if spans and w - 1 in hit:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return spans


class Scanner:
    """Scans lists of texts with the automata of all slices; of several automata only one is held at a time."""

    def __init__(self, slices: list, width: int):
        self.slices, self.width = slices, width
        self.only = _machine(slices[0].value, width) if len(slices) == 1 else None

    def scan(self, texts: list[str | None], code_points: bool) -> list[tuple]:
        """(words, words hit, items, spans) of every text."""
        many, hits, items = [0] * len(texts), [set() for _ in texts], [set() for _ in texts]
        for s in self.slices:
            machine = self.only if len(self.slices) == 1 else _machine(s.value, self.width)
            for k, t in enumerate(texts):
                words = normalised(t)  # anew for each automaton: the words of a whole frame would fill the memory
                many[k] = len(words)
                if words and machine is not None:
                    _hits(words, machine, hits[k], items[k])
        return [(n, sorted(h), sorted(i), _spans(t, h) if h and code_points else []) for t, n, h, i in zip(texts, many, hits, items)]


def scanner(benchmark: DataFrame, width: int = WIDTH, most: int = MOST_PATTERNS):
    """Makes a Scanner of all items of the benchmark, for use in a task.

    The benchmark is a small curated table; its items come to the driver in slices by hash, each slice is
    broadcast and becomes one automaton.
    """
    spark = ready(benchmark.sparkSession)
    known = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = 1 + total // (most * 2)
    shared = []
    for s in range(slices):
        part = known if slices == 1 else known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s)
        shared.append(spark.sparkContext.broadcast([tuple(r) for r in part.collect()]))
    return lambda: Scanner(shared, width)


def _groups(frames, least: int):
    """Frames, put together up to so many characters if least is positive, so that automata are not built anew for each."""
    held, n = [], 0
    for f in frames:
        held.append(f)
        n += sum(len(t) for t in f["text"] if t is not None)
        if n >= least:
            yield held
            held, n = [], 0
    if held:
        yield held


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, code_points: bool = True, most: int = MOST_PATTERNS) -> DataFrame:
    """Per document row its words, the words hit, the items found and the spans of hit words in the original text.

    All slices of the benchmark are scanned in one pass over the documents, so that every row unites its own hits.
    """
    make = scanner(benchmark, width, most)

    def work(batches):
        scanner_ = make()
        pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pair)]
        frames = ({"text": b.column(1).to_pylist(), "batch": b} for b in _text.portions(batches, 1))
        for group in _groups(frames, GROUP if len(scanner_.slices) > 1 else 0):
            rows = iter(scanner_.scan([t for f in group for t in f["text"]], code_points))
            for f in group:
                found = [(n, h, i, [{"start": a, "end": b} for a, b in s]) for n, h, i, s in (next(rows) for _ in f["text"])]
                yield pa.record_batch([f["batch"].column(0), *(pa.array(c, t) for c, t in zip(zip(*found), types))], ["doc_id", "n_words", "hit_words", "items", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, HITS)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST_PATTERNS) -> DataFrame:
    """The document rows without a hit, each by its own text and with all its columns."""
    make, column = scanner(benchmark, width, most), docs.columns.index("text")

    def work(batches):
        scanner_ = make()
        frames = ({"text": b.column(column).to_pylist(), "batch": b} for b in _text.portions(batches, column))
        for group in _groups(frames, GROUP if len(scanner_.slices) > 1 else 0):
            rows = iter(scanner_.scan([t for f in group for t in f["text"]], False))
            for f in group:
                yield f["batch"].filter(pa.array([not next(rows)[1] for _ in f["text"]], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), code_points=False)
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
