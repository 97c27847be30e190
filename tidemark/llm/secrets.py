"""Secret scans behind a trigram inverted index.

Each rule's regular expression yields a Boolean trigram query: an OR over its alternatives of an AND over
windows of three adjacent character sets. A batch of texts is indexed for the trigrams that any rule
asks for, postings are intersected, and only candidates are run through the expression. Rules without
mandatory trigrams scan all texts.

Null texts count as empty and hold no secrets. Repeated rows and null ids each get a row. Spans
are in code points of the whole text, whatever its length; of spans with one start the rules' order decides.
An empty table gives an empty result. Further columns are left out of scans and kept by redaction.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import ready, table

Query = list[list[list[str]]]


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED


def _sequences(tree) -> list[list[frozenset | None]]:
    """All ways through a parsed expression as lists of character sets; None where anything may stand."""
    ways: list[list] = [[]]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more = [[frozenset(chr(arg).lower())]]
        elif name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in arg):
            chars = set()
            for k, v in arg:
                chars.update(chr(c).lower() for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1)))
            more = [[frozenset(chars)]]
        elif name == "SUBPATTERN":
            more = _sequences(arg[-1])
        elif name == "BRANCH":
            more = [w for branch in arg[1] for w in _sequences(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            if low == 0 and high == 1:
                more = [[], *_sequences(body)]
            else:
                inner = _sequences(body)
                more = [inner[0] * min(low, 8) + ([] if low == high <= 8 else [None])] if len(inner) == 1 else [[None]]
        elif name == "AT":
            more = [[]]
        else:
            more = [[None]]
        ways = [a + b for a in ways for b in more]
        if len(ways) > 256:
            return [[None]]
    return ways


def trigram_query(pattern: str, most: int = 8) -> Query | None:
    """OR of ANDs of ORs of lower-case trigrams that every match holds; None if some match need hold none."""
    query = []
    for way in _sequences(re._parser.parse(pattern)):
        windows = []
        for three in zip(way, way[1:], way[2:]):
            if None not in three and np.prod([len(s) for s in three]) <= most and all(c < "\x80" for s in three for c in s):
                windows.append(sorted({"".join(t) for t in itertools.product(*three)}))
        if not windows:
            return None
        if windows not in query:
            query.append(windows)
    return query


class Index:
    """Postings of a batch of texts, for the trigrams that are asked for."""

    def __init__(self, trigrams: list[str]):
        self.trigrams = trigrams
        self.luts = []
        for block in range(0, len(trigrams), 64):
            lut = np.zeros((3, 256), np.uint64)
            for bit, t in enumerate(trigrams[block : block + 64]):
                for i, c in enumerate(t):
                    lut[i, ord(c)] |= np.uint64(1) << np.uint64(bit)
            self.luts.append(lut)

    def postings(self, texts: list[str]) -> dict[str, set[int]]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n\n".join(raw).lower(), np.uint8)
        starts = np.cumsum([0, *(len(r) + 2 for r in raw)])
        out: dict[str, set[int]] = {t: set() for t in self.trigrams}
        for lo in range(0, max(0, len(data) - 2), 1 << 20):
            part = data[lo : lo + (1 << 20) + 2]
            for b, lut in enumerate(self.luts):
                mask = lut[0][part[:-2]]
                mask &= lut[1][part[1:-1]]
                mask &= lut[2][part[2:]]
                at = np.flatnonzero(mask)
                if len(at):
                    row, bits = np.searchsorted(starts, at + lo, "right") - 1, mask[at]
                    for bit, t in enumerate(self.trigrams[64 * b : 64 * b + 64]):
                        out[t].update(np.unique(row[(bits >> np.uint64(bit)) & np.uint64(1) == 1]).tolist())
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        wanted = sorted({t for _, _, q in self.rules if q for way in q for window in way for t in window})
        self.index = Index(wanted)

    def candidates(self, texts: list[str]) -> list[set[int] | range]:
        found, out = self.index.postings(texts), []
        for _, _, query in self.rules:
            if query is None:
                out.append(range(len(texts)))
            else:
                out.append(set().union(*(set.intersection(*(set().union(*(found[t] for t in w)) for w in way)) for way in query)))
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        spans: list[list] = [[] for _ in texts]
        for order, ((rule, expression, _), rows) in enumerate(zip(self.rules, self.candidates(texts))):
            for i in rows:
                spans[i] += [(m.start(), order, rule.kind, m.end()) for m in expression.finditer(texts[i]) if rule.keep(m)]
        return [[(kind, a, b) for a, _, kind, b in sorted(s)] for s in spans]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans of all rules, and the text with every span replaced by [kind] (overlapping spans together, by the first)."""
    names = [r.kind for r in rules]
    own = None if rules is RULES else [(r.kind, r.pattern) for r in rules]

    def work(batches):
        scanner = Scanner(RULES if own is None else tuple(Rule(k, p) for k, p in own))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in _text.portions(batches, 1):
            given = b.column(1).to_pylist()
            found = scanner.scan([t or "" for t in given])
            spans = [[{"kind": k, "start": x, "end": y} for k, x, y in s] for s in found]
            yield pa.record_batch([b.column(0), pa.array(spans, kind), pa.array([redact(t, s) if s else t for t, s in zip(given, found)], pa.string())], ["doc_id", "spans", "redacted"])

    assert len(set(names)) == len(names)
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, f"doc_id long, spans {SPANS}, redacted string")


def redacted(docs: DataFrame) -> DataFrame:
    """The document rows with every span replaced by [kind] and n_chars counted anew where there is one; all else as it is."""
    ready(docs.sparkSession)
    text, n_chars = docs.columns.index("text"), docs.columns.index("n_chars")

    def work(batches):
        scanner = Scanner()
        for batch in _text.portions(batches, text):
            texts, counts = batch.column(text).to_pylist(), batch.column(n_chars).to_pylist()
            for i, spans in enumerate(scanner.scan([t or "" for t in texts])):
                if spans:
                    texts[i] = redact(texts[i], spans)
                    counts[i] = len(texts[i])
            for at, values in ((text, texts), (n_chars, counts)):
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(work, docs.schema)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in BASE]

    def digest(batches):
        scanner = Scanner()
        for b in _text.portions(batches, 1):
            rows = []
            for spans in scanner.scan([t or "" for t in b.column(1).to_pylist()]):
                kept = [s for s in spans if s[0] in base]
                rows.append((*(sum(s[0] == k for s in kept) for k in base), hashlib.sha256(_joined(kept).encode()).hexdigest(), _joined(spans)))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
