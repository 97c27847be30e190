"""Removal of passages that another document with a smaller id holds, found with suffix arrays.

Every run of `length` bytes is named by the least hash of its inner grams, so that equal runs, wherever they
are, have one name. Neighbouring runs of one name are a segment. Later copies of a whole text go whole and are
not looked into; a bitmap of first copies, which may let some of the others through, decides. Names of one
document are dropped before anything is shipped. Segments are compared by 64-bit hashes first: where all
segments of a name are equal, their least document decides at once. Only of names with several contents one copy
of each content is shipped to the name's shard, which sorts the suffixes that begin a run whose hash occurs
twice, word by word, and finds, from those that stay tied, the least document of each run. Shards share no runs,
so their arrays need no merging. The places of such names wait for that; so do those of names with very many
places, which are summed up first and joined with salts.

Null texts count as empty; texts shorter than a run keep all bytes, longer ones are judged whole; copies
under one id do not remove each other; of several texts of one id each has its own result; repeated rows
each get a row; rows of a null id are left as they are and remove nothing; an empty table gives an empty
result; further columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import ready, saved, table
from .blobs import maybe, wide_bitmap

LENGTH, GRAM = 50, 24
#: Bytes of text hashed at a time, which should stay in a core's cache, and of segments sorted at once (more only if one name has more).
CHUNK, BLOCK = 64 << 10, 2 << 20
#: Segments gathered before they are dealt out.
LOT = 1 << 19
#: Text to one task.
PART = 32 << 20
#: Places of a segment in one join task; segments with more are salted. Names with more are hot.
HOT = 4096
#: Names that occur less often among the segments dealt out at once are not counted exactly.
HEAVY = 32


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first place, end, name, hash of the segment) of every segment: neighbouring runs of one name in one text."""
    n, k = len(data), length - GRAM + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums, down = _sums(data)
    h = sums[GRAM:] - sums[:-GRAM]
    h *= down[: n - GRAM + 1]
    h = _text.mix(h)
    width = 1
    while 2 * width <= k:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < k:
        h = np.minimum(h[: len(h) - (k - width)], h[k - width :])
    h |= np.uint64(1)
    over = (offsets[1:, None] - 1 - np.arange(length - 1)).ravel()
    h[over[(over >= 0) & (over < len(h))]] = 0  # no run crosses a text's end, so equal names in neighbouring texts are apart
    cut = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
    a, b = cut[:-1], cut[1:]
    real = h[a] != 0
    a, b = a[real], b[real]
    # least hashes are small numbers: mixed again, names are spread evenly over bitmaps and parts
    return a, b, _text.mix(h[a]), _text.mix((sums[b + length - 1] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which every stretch has its hash, (sums[b] - sums[a]) * down[a]."""
    n = len(data)
    up, down = _text._power(max(n, CHUNK) + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    weights = _text._BYTES[data]
    weights *= up[:n]
    np.cumsum(weights, out=sums[1:])
    return sums, down


def _chunks(batch, length: int, firsts):
    """(ids, keys, data, offsets, segments) of an Arrow batch of (doc_id, text, key, mark), ids not null, without later copies of a text."""
    batch = batch.filter(pa.array(maybe(batch.column(3).to_numpy(), firsts)))
    data, offsets = _text.buffer(batch.column(1))
    ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
    for lo, hi in _text.chunks(offsets, CHUNK):
        d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield ids[lo:hi], keys[lo:hi], d, o, runs(d, o, length)


def _lots(batches, rows_of):
    """What rows_of(batch) yields, joined to arrays of LOT rows or a little more."""
    held, n = [], 0
    for batch in batches:
        for e in rows_of(batch):
            held.append(e)
            n += len(e)
            if n >= LOT:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def _dealt(part: np.ndarray, *columns: np.ndarray):
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(cut[1:], len(part))
    return part[cut], [[x[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist())] for x in (c[order] for c in columns)]


def suffix_array(data: np.ndarray, depth: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the suffixes at `starts`, or all, sorted by their first `depth` bytes; those tied to that depth have one group.

    Words of seven bytes, and the number of bytes that are left, refine only groups that are still tied.
    """
    n = len(data)
    word = np.zeros(n, np.uint64)
    for k in range(min(7, n)):
        word[: n - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.arange(n) if starts is None else starts.copy()
    group = np.zeros(len(order), np.int64)
    where = np.arange(len(order))
    for h in range(0, depth, 7):
        if len(where) < 2:
            break
        some, take = order[where], min(7, depth - h)
        left = np.clip(n - some - h, 0, take)
        after = word[np.minimum(some + h, n - 1)] >> np.uint64(64 - 8 * take) << np.uint64(64 - 8 * take)
        after = np.where(left > 0, after, np.uint64(0)) | left.astype(np.uint64)
        of = group[where]
        by = np.lexsort((after, of)) if h else np.argsort(after, kind="stable")
        some, after, of = some[by], after[by], of[by]
        order[where] = some
        new = np.ones(len(some), bool)
        new[1:] = (of[1:] != of[:-1]) | (after[1:] != after[:-1])
        group[where] = where[np.flatnonzero(new)][np.cumsum(new) - 1]
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = where[tied]
    return order, group


def least_owner(segments: list[bytes], owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, end, least): for each segment its stretches of places whose runs have the same least owner over all segments."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(s) for s in segments])
    ends = np.cumsum(size)
    n = np.maximum(size - length + 1, 0)
    of = np.repeat(np.arange(len(segments)), n)
    begin = ends - size
    place = np.arange(n.sum()) + (begin - (np.cumsum(n) - n))[of]
    out = owner[of]
    sums, down = _sums(data)
    h = (sums[place + length] - sums[place]) * down[place]
    by = np.argsort(h, kind="stable")
    same = h[by[1:]] == h[by[:-1]]
    twice = np.zeros(len(by), bool)
    twice[1:] |= same
    twice[:-1] |= same
    some = np.sort(by[twice])  # a run whose hash occurs once is in one segment only
    if len(some):
        order, group = suffix_array(data, length, place[some])
        at = np.searchsorted(place, order)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[at] = np.repeat(np.minimum.reduceat(out[at], first), np.diff(np.append(first, len(order))))
    new = np.ones(len(place), bool)
    new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return of[first], place[first] - begin[of[first]], place[last] + 1 - begin[of[first]], out[first]


_SEEN = np.dtype([("name", "<u8"), ("segment", "<u8"), ("least", "<i8"), ("greatest", "<i8"), ("n", "<i8")])
_PLACE = np.dtype([("name", "<u8"), ("segment", "<u8"), ("doc_id", "<i8"), ("key", "<i8"), ("at", "<u4"), ("n", "<u4")])
_WAITING = np.dtype([("segment", "<u8"), ("doc_id", "<i8"), ("key", "<i8"), ("at", "<u4"), ("n", "<u4")])
_SPAN = np.dtype([("doc_id", "<i8"), ("key", "<i8"), ("start", "<u4"), ("end", "<u4")])
#: Kinds of rows: places, sums and waiting places that are dealt out; spans, wanted contents, sole contents and waiting places that are decided.
PLACES, SUMS, WAITING, SPANS, WANTED, ALONE = range(6)


def _united(e: np.ndarray) -> np.ndarray:
    """One row for each name and segment, sorted."""
    e = e[np.lexsort((e["segment"], e["name"]))]
    first = np.flatnonzero(np.concatenate([[True], (e["name"][1:] != e["name"][:-1]) | (e["segment"][1:] != e["segment"][:-1])]))
    out = e[first].copy()
    out["least"], out["greatest"], out["n"] = (f.reduceat(e[c], first) for f, c in ((np.minimum, "least"), (np.maximum, "greatest"), (np.add, "n")))
    return out


def _made(kind: np.dtype, **columns) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), kind)
    for c, x in columns.items():
        out[c] = x
    return out


def _summed(e: np.ndarray) -> np.ndarray:
    """The sums of places."""
    return _united(_made(_SEEN, name=e["name"], segment=e["segment"], least=e["doc_id"], greatest=e["doc_id"], n=1))


def _names(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of sorted sums: whether its name has no other content, and the name's least and greatest document."""
    first = np.flatnonzero(np.concatenate([[True], e["name"][1:] != e["name"][:-1]]))
    many = np.diff(np.append(first, len(e)))
    return np.repeat(many == 1, many), np.repeat(np.minimum.reduceat(e["least"], first), many), np.repeat(np.maximum.reduceat(e["greatest"], first), many)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype("<u8")).view(pa.int64()) if x.dtype.kind == "u" else pa.array(x.astype(np.int64))


def _unpacked(rows: DataFrame, kind: int, of: np.dtype, columns: list[str]) -> DataFrame:
    def columned(batches):
        for b in batches:
            for r in b.column(0):
                e = np.frombuffer(r.as_buffer(), of)
                yield pa.record_batch([_long(e[c]) for c in columns], columns)

    return rows.filter(F.col("kind") == kind).select("rows").mapInArrow(columned, ", ".join(f"{c} long" for c in columns))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, mark): the text's hash, and one of it and the id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("key", F.xxhash64("text")).withColumn("mark", F.xxhash64("doc_id", "key"))


def repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, tuple[int, np.ndarray]]:
    """Of marked docs without null ids: (doc_id, key, spans) of bytes covered by runs that also start in a document with a smaller id, as merged
    pairs of 32-bit starts and ends; and a bitmap of marks: rows outside it are later copies of a whole text, have no spans and are covered."""
    spark = ready(docs.sparkSession)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.groupBy("key", F.octet_length("text").alias("size")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    texts = saved(texts.select(F.xxhash64("first", "key").alias("mark"), (F.col("size") * F.col("n")).alias("size")))
    size, different = texts.agg(F.sum("size"), F.count("*")).first()
    tasks = max(tasks, 1 + int(size or 0) // PART)
    bits = min(max(int(8 * tasks - 1).bit_length(), 4), 24)
    first_marks = wide_bitmap(texts.select("mark"), different)
    firsts = spark.sparkContext.broadcast(first_marks)
    cut = np.uint64(32 - bits)

    def parts(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - bits)).astype(np.int64)

    def of_text(e: np.ndarray) -> np.ndarray:
        return parts(e["key"].astype(np.uint64))

    def rows(kind: int, part: np.ndarray, e: np.ndarray):
        part, (body,) = _dealt(part, e)
        return pa.record_batch([pa.array([kind] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array(body, pa.binary())], ["kind", "part", "rows"])

    def whole(kind: int, e: np.ndarray):
        return rows(kind, np.zeros(len(e), np.int64), e)

    def count(batches):
        def named(batch):
            for ids, _, _, o, (a, _, name, _) in _chunks(batch, length, firsts.value):
                yield _made(np.dtype([("name", "<u8"), ("doc_id", "<i8")]), name=name, doc_id=ids[np.searchsorted(o, a, "right") - 1])

        for e in _lots(batches, named):
            e = e[np.argsort(e["name"], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], e["name"][1:] != e["name"][:-1]]))
            many = np.minimum.reduceat(e["doc_id"], first) < np.maximum.reduceat(e["doc_id"], first)
            n = np.diff(np.append(first, len(e))).astype("<u4")
            key = e["name"][first] >> cut
            heavy = n >= HEAVY
            for some, more, exact in ((~many & ~heavy, False, False), (many & ~heavy, True, False), (~many & heavy, False, True), (many & heavy, True, True)):
                part, (low, counts) = _dealt((key[some] >> np.uint64(32)).astype(np.int64), key[some].astype("<u4"), n[some])
                yield pa.record_batch([pa.array(part, pa.int32()), pa.array(low, pa.binary()), pa.array([more] * len(part), pa.bool_()), pa.array(counts if exact else [None] * len(part), pa.binary())], ["part", "names", "more", "counts"])

    def often(batches):
        held = []
        for b in batches:
            for part, low, more, counts in zip(*(b.column(i).to_pylist() for i in range(4))):
                k = np.frombuffer(low, "<u4").astype(np.int64) | part << 32
                held.append(_made(np.dtype([("name", "<i8"), ("docs", "u1"), ("n", "<u4")]), name=k, docs=1 + more, n=np.frombuffer(counts, "<u4") if counts else 1 + more))
        if held:
            e = np.concatenate(held)
            held.clear()
            e = e[np.argsort(e["name"], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], e["name"][1:] != e["name"][:-1]]))
            use = np.add.reduceat(e["docs"], first, dtype=np.int64) > 1
            hot = np.add.reduceat(e["n"], first, dtype=np.int64) >= HOT
            yield pa.record_batch([_long(e["name"][first[use]].astype(np.uint64) << cut), pa.array(hot[use])], ["name", "hot"])

    named = docs.mapInArrow(count, "part int, names binary, more boolean, counts binary").repartition(tasks, "part")
    named = saved(named.mapInArrow(often, "name long, hot boolean"))
    repeated = spark.sparkContext.broadcast(wide_bitmap(named.select("name"), named.count()))
    # at most one to HOT segments that the corpus holds
    hot_names = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in named.filter("hot").select("name").collect()], np.int64).view(np.uint64)))

    def occurring(batches):
        def placed(batch):
            for ids, keys, _, o, (a, b, name, segment) in _chunks(batch, length, firsts.value):
                use = maybe(name, repeated.value)
                a, b = a[use], b[use]
                doc = np.searchsorted(o, a, "right") - 1
                yield _made(_PLACE, name=name[use], segment=segment[use], doc_id=ids[doc], key=keys[doc], at=a - o[doc], n=b - a)

        hot = hot_names.value
        for e in _lots(batches, placed):
            if len(hot):
                k = e["name"] >> cut << cut
                warm = hot[np.minimum(np.searchsorted(hot, k), len(hot) - 1)] == k
                some, e = e[warm], e[~warm]
                if len(some):
                    sums = _summed(some)
                    yield rows(SUMS, parts(sums["name"]), sums)
                    yield rows(WAITING, of_text(some), _made(_WAITING, **{c: some[c] for c in _WAITING.names}))
            if len(e):
                yield rows(PLACES, parts(e["name"]), e)

    def decide(batches):
        held, sums, waiting, n = [], [], [], 0
        for b in batches:
            for kind, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if kind == WAITING:
                    waiting.append(np.frombuffer(r, _WAITING))
                    n += len(waiting[-1])
                    if n >= LOT // 4:
                        yield whole(kind, np.concatenate(waiting))
                        waiting, n = [], 0
                else:
                    (held if kind == PLACES else sums).append(np.frombuffer(r, _PLACE if kind == PLACES else _SEEN))
        if waiting:
            yield whole(WAITING, np.concatenate(waiting))
        if held:
            e = np.concatenate(held)
            held.clear()
            e = e[np.lexsort((e["segment"], e["name"]))]
            new = np.concatenate([[True], (e["name"][1:] != e["name"][:-1]) | (e["segment"][1:] != e["segment"][:-1])])
            first = np.flatnonzero(new)
            s = _made(_SEEN, name=e["name"][first], segment=e["segment"][first], least=np.minimum.reduceat(e["doc_id"], first), greatest=np.maximum.reduceat(e["doc_id"], first), n=np.diff(np.append(first, len(e))))
            sole, low, top = _names(s)
            wanted = s[~sole & (low < top)]  # all else occurs in one document only
            n = s["n"]
            late = e["doc_id"] > np.repeat(low, n)
            sole = np.repeat(sole, n)
            p = e[late & sole]
            if len(p):
                yield rows(SPANS, of_text(p), _made(_SPAN, doc_id=p["doc_id"], key=p["key"], start=p["at"], end=p["at"] + p["n"] + np.uint32(length - 1)))
            p = e[late & ~sole]
            if len(p):
                yield whole(WAITING, _made(_WAITING, **{c: p[c] for c in _WAITING.names}))
            if len(wanted):
                yield whole(WANTED, wanted)
        if sums:
            s = _united(np.concatenate(sums))
            sole, low, top = _names(s)
            for kind, use in ((ALONE, sole & (low < top)), (WANTED, ~sole & (low < top))):
                if use.any():
                    yield whole(kind, s[use])

    packed = "kind int, part int, rows binary"
    seen = saved(docs.mapInArrow(occurring, packed).repartition(tasks, "part").mapInArrow(decide, packed))
    wanted = _unpacked(seen, WANTED, _SEEN, ["segment", "name", "least", "greatest", "n"])
    sole = _unpacked(seen, ALONE, _SEEN, ["segment", "least", "n"])
    holder = saved(wanted.select(F.col("segment").bitwiseXOR(F.shiftleft("least", 24)).alias("key")))
    held_by = spark.sparkContext.broadcast(wide_bitmap(holder, holder.count()))

    def contents(batches):
        for batch in batches:
            for ids, _, d, o, (a, b, name, segment) in _chunks(batch, length, firsts.value):
                doc = ids[np.searchsorted(o, a, "right") - 1] if len(a) else np.zeros(0, np.int64)
                use = np.flatnonzero(maybe(segment ^ (doc.astype(np.uint64) << np.uint64(24)), held_by.value))
                use = use[maybe(name[use], repeated.value)]
                if not len(use):
                    continue
                _, once = np.unique(segment[use], return_index=True)
                use = use[once]
                raw = d.tobytes()
                body = [raw[x : y + length - 1] for x, y in zip(a[use].tolist(), b[use].tolist())]
                yield pa.record_batch([_long(segment[use]), pa.array(body, pa.binary())], ["segment", "body"])

    def judge(batches):
        def decided(rows):
            of, first, end, least = least_owner([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), length)
            use = least < np.array([r[3] for r in rows], np.int64)[of]  # for the others there is no later document
            segment = np.array([r[0] for r in rows], np.int64)[of]
            return pa.record_batch([pa.array(c[use], pa.int64()) for c in (segment, first, end, least)], ["segment", "first", "last", "least"])

        rows, size, current = [], 0, None
        for b in batches:
            for name, *row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if name != current and size >= BLOCK:
                    yield decided(rows)
                    rows, size = [], 0
                current = name
                rows.append(row)
                size += len(row[1])
        if rows:
            yield decided(rows)

    shipped = docs.mapInArrow(contents, "segment long, body binary").join(wanted.drop("n"), "segment").dropDuplicates(["segment"])
    shipped = shipped.select("name", "segment", "body", "least", "greatest").repartition(tasks, "name").sortWithinPartitions("name")
    mixed = shipped.mapInArrow(judge, "segment long, first long, last long, least long")
    alone = sole.select("segment", F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"), "least")
    # hot segments are at most one to HOT segments that the corpus holds, a few for each common passage
    hot = F.broadcast(saved(wanted.select("segment", "n").unionByName(sole.select("segment", "n")).filter(F.col("n") >= HOT).select("segment", F.ceil(F.col("n") / HOT).alias("salts"))))
    found = mixed.unionByName(alone).join(hot, "segment", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts")
    where = _unpacked(seen, WAITING, _WAITING, ["segment", "doc_id", "key", "at", "n"]).join(hot, "segment", "left")
    where = where.withColumn("salt", F.expr("pmod(doc_id, coalesce(salts, 1))")).drop("salts")
    both = where.join(found, ["segment", "salt"]).filter("least < doc_id")
    last = F.when(F.col("last") < 0, F.col("n")).otherwise(F.col("last"))
    both = both.select(F.shiftrightunsigned("key", 64 - bits).cast("int").alias("part"), "doc_id", "key", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + last + (length - 1)).alias("end"))

    def merged(batches):
        held = []
        for b in batches:
            held += [np.frombuffer(r, _SPAN) for r in b.column(1).drop_null().to_pylist()]
            single = b.filter(b.column(1).is_null())
            held.append(_made(_SPAN, **{c: single.column(c).to_numpy() for c in _SPAN.names}))
        e = np.concatenate(held) if held else np.zeros(0, _SPAN)
        held.clear()
        if len(e):
            e = e[np.lexsort((e["start"], e["key"], e["doc_id"]))]
            row = np.concatenate([[True], (e["doc_id"][1:] != e["doc_id"][:-1]) | (e["key"][1:] != e["key"][:-1])])
            base = np.cumsum(row) << 33
            reach = np.maximum.accumulate(base + e["end"])
            new = row.copy()
            new[1:] |= base[1:] + e["start"][1:] > reach[:-1]
            first = np.flatnonzero(new)
            pairs = np.stack([e["start"][first], (reach[np.append(first[1:], len(e)) - 1] - base[first]).astype("<u4")], axis=1)
            at = np.flatnonzero(row[first])
            ends = np.append(at[1:], len(first))
            yield pa.record_batch([pa.array(e["doc_id"][first[at]]), pa.array(e["key"][first[at]]), pa.array([pairs[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist())], pa.binary())], ["doc_id", "key", "spans"])

    spans = seen.filter(F.col("kind") == SPANS).select("part", "rows").unionByName(both, allowMissingColumns=True)
    return spans.repartition(tasks, "part").mapInArrow(merged, "doc_id long, key long, spans binary"), first_marks


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH, bodies: bool = True) -> DataFrame:
    """A row for each of docs; without bodies, kept is null."""
    docs = marked(docs)
    found, first_marks = repeats(docs.filter("doc_id is not null"), length)
    firsts = docs.sparkSession.sparkContext.broadcast(first_marks)

    def cut(batches):
        for batch in batches:
            data, offsets = _text.buffer(batch.column(1))
            later = ~maybe(batch.column(2).to_numpy(), firsts.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi in _text.chunks(offsets, 1 << 20):
                d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                size = np.diff(o)
                given = [np.frombuffer(s or b"", "<u4").reshape(-1, 2) for s in batch.column(3).slice(lo, hi - lo).to_pylist()]
                for i in np.flatnonzero(later[lo:hi] & (size >= length)).tolist():
                    given[i] = np.array([[0, size[i]]], "<u4")
                n = np.array([len(s) for s in given])
                pairs = np.concatenate(given).astype(np.int64) + np.repeat(o[:-1], n)[:, None]
                edge = np.zeros(len(d) + 1, np.int8)
                edge[pairs[:, 0]] += 1
                edge[pairs[:, 1]] -= 1  # maximal runs neither meet nor overlap, but one may end where the next text's begins
                kept = d[np.cumsum(edge[:-1], dtype=np.int8) == 0].tobytes()
                gone = np.concatenate([[0], np.cumsum(pairs[:, 1] - pairs[:, 0])])[np.cumsum(n)] if len(n) else np.zeros(0, np.int64)
                removed = np.diff(gone, prepend=0)
                at = (o - np.concatenate([[0], gone])).tolist()
                body = [kept[a:b] for a, b in zip(at[:-1], at[1:])]
                columns = [pa.array(size), pa.array(removed), pa.array(n, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in body]), pa.array(body if bodies else [None] * len(body), pa.binary())]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *columns], RESULT.replace(",", "").split()[::2])

    return docs.join(found.hint("shuffle_hash"), ["doc_id", "key"], "left").select("doc_id", "text", "mark", "spans").mapInArrow(cut, RESULT)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), bodies=False).drop("kept")
