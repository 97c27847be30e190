"""Exact Jaccard self-join of word-shingle sets in the metric space of Jaccard distance.

Equal sets become one node first. Most sets are at distance 1 from all others, where no pivot tells them
apart, so nodes are grouped before: two sets at distance r = 1 - similarity or less share a shingle of their
prefixes (rarest quarter of each, by counts over all documents), and sketches rule out by an exact bound
most of what meets by chance. What still hangs together is a cell; each node is in one cell.

A cell of more than LEAF nodes is split: pivots are picked by hash, every node is measured against all of
them and belongs to the Voronoi region of the nearest. A node that links to a pivot is contracted with it.
Two linked nodes that no contraction has united yet meet, since nodes outside the cell's greatest component
are replicated into every region j with d(x, p_j) <= d(x, nearest) + 2r (triangle inequality). Regions of
one component are done, large ones are split again, and regions that windows no longer shrink are cut into
blocks of outside nodes against the rest. Cells of at most LEAF nodes are joined in one task, which
compares only nodes of different components.

Null and wordless texts have no set and are linked with nothing; shorter texts have one shingle; texts of
any length take part whole; repeated rows of one id each get a row; a component of null ids alone has the
null id; ties do not exist, since links are exact; an empty table gives an empty result; further columns
are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._spark import ready, saved, table, written
from .blobs import bitmap, maybe
from .components import components

WIDTH, PERCENT = 5, 75
#: Cells of at most so many nodes and shingles are joined in one task.
LEAF, LEAF_SHINGLES = 1024, 2_000_000
#: Pivots of a cell: one to so many nodes, within these bounds.
TO_PIVOT, FEWEST, MOST_PIVOTS = 512, 8, 64
#: Splits of a cell before what is left is cut into blocks.
LEVELS = 4
#: A shingle in so many sets is frequent and comes late in prefixes; at most MOST of them, the most frequent, are told to the tasks. No result depends on it.
FREQUENT, MOST = 8, 1_000_000
#: Entries of a shingle in so many sets are spread over all tasks.
HOT = 4096
#: Shingles or prefix entries to one task.
ENTRIES = 4_000_000
#: A sketch has one slice to two members, 2**LEAST_BITS to 2**MOST_BITS in all.
LEAST_BITS, MOST_BITS = 4, 15
#: Bytes of a shingle's hash that verification keeps.
KEPT = 6
#: Rows of one node are joined by so many tasks.
SALTS = 8


def _nodes(hashes: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set, from all its members."""
    return np.array([_text.mix(np.array([np.bitwise_xor.reduce(_text.mix(s)) + np.uint64(len(s))], np.uint64) + s.sum())[0] if len(s) else 0 for s in hashes], np.uint64)


def _sets(batch, width: int):
    """Chunks of (doc_ids, sets, nodes) of an Arrow batch of (doc_id, text)."""
    ids = batch.column(0)
    data, offsets = _text.buffer(batch.column(1))
    for lo, hi in _text.chunks(offsets, 5 << 20):
        h, first = _text.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        found = _text.shingles(h, first, width)
        yield ids[lo:hi], found, _nodes(found)


def _distinct(found: list[np.ndarray], nodes: np.ndarray) -> list[int]:
    _, first = np.unique(nodes, return_index=True)
    return [i for i in first.tolist() if len(found[i])]


def _bits(n: int) -> int:
    return min(max(int(n - 1).bit_length() - 1, LEAST_BITS), MOST_BITS)


def _sketch(s: np.ndarray) -> bytes:
    """How many members fall into each slice of the hash space, up to 15, two counts to a byte; differences of two sketches are never more than the sets'."""
    bits = _bits(len(s))
    count = np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return (count[::2] | count[1::2] << 4).tobytes()


def _pack(s: np.ndarray) -> bytes:
    """The low KEPT bytes of each hash, sorted."""
    low = np.sort(s & np.uint64((1 << 8 * KEPT) - 1))
    return low.view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def _unpack(p: bytes) -> np.ndarray:
    out = np.zeros((len(p) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(p, np.uint8).reshape(-1, KEPT)
    return out.view("<u8").ravel()


def members(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, row if there is one, n_shingles, node and sketch of every document."""
    names = [c for c in docs.columns if c != "text"] + ["n_shingles", "node", "sketch"]

    def work(batches):
        for batch in batches:
            at = 0
            for ids, found, nodes in _sets(batch, width):
                more = [c[at : at + len(ids)] for c in batch.columns[2:]]
                at += len(ids)
                yield pa.record_batch([ids, *more, pa.array([len(s) for s in found], pa.int64()), pa.array(nodes.view(np.int64)), pa.array([_sketch(s) for s in found], pa.binary())], names)

    return docs.mapInArrow(work, ", ".join(f"{n} {'binary' if n == 'sketch' else 'long'}" for n in names))


def _dealt(part: np.ndarray, *columns: np.ndarray):
    """The parts that occur, and for each column the bytes of each part's values."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(cut[1:], len(part))
    return part[cut], [[x[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist())] for x in (c[order] for c in columns)]


def frequent(docs: DataFrame, width: int, bits: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles by their top 32 + bits bits, sorted, and how many sets hold each.

    Every shingle of every set is counted, as 32 bits within one of 2**bits parts of the hash space.
    """

    def work(batches):
        for batch in batches:
            for _, found, nodes in _sets(batch, width):
                keep = _distinct(found, nodes)
                if keep:
                    h, n = np.unique(np.concatenate([found[i] for i in keep]) >> np.uint64(32 - bits), return_counts=True)
                    part, low, once = (h >> np.uint64(32)).astype(np.int64), h.astype("<u4"), n == 1
                    for some, counted in ((once, False), (~once, True)):
                        parts, (keys, counts) = _dealt(part[some], low[some], n[some].astype("<u4"))
                        yield pa.record_batch([pa.array(parts, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts if counted else [None] * len(parts), pa.binary())], ["part", "keys", "counts"])

    def gather(batches):
        keys, counts = [], []
        for b in batches:
            for p, k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                k = np.frombuffer(k, "<u4").astype(np.int64) | p << 32
                keys.append(k)
                counts.append(np.ones(len(k), np.uint32) if n is None else np.frombuffer(n, "<u4"))
        if keys:
            k, n = np.concatenate(keys), np.concatenate(counts)
            keys.clear(), counts.clear()
            order = np.argsort(k)
            k, n = k[order], n[order]
            first = np.flatnonzero(np.diff(k, prepend=-1))
            n = np.add.reduceat(n.astype(np.int64), first)
            yield pa.record_batch([pa.array(k[first][n >= FREQUENT]), pa.array(n[n >= FREQUENT])], ["h", "n"])

    counted = saved(docs.mapInArrow(work, "part int, keys binary, counts binary").repartition(tasks, "part").mapInArrow(gather, "h long, n long"))
    many = counted.count()
    if many > MOST:
        counted = counted.filter(F.col("n") > counted.approxQuantile("n", [1 - MOST / many], 0.001)[0])
    got = counted.toPandas().sort_values("h")  # about MOST rows at most
    return got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)


_ENTRY = np.dtype([("h", "<u4"), ("node", "<u8")])


def regions(docs: DataFrame, width: int, percent: int, bits: int, tasks: int, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(region, node) of every prefix shingle that two or more nodes share; regions of the same nodes are told once by each task."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def prefixes(batches):
        last, count = shared.value
        for batch in batches:
            for _, found, nodes in _sets(batch, width):
                keep = _distinct(found, nodes)
                if not keep:
                    continue
                h = np.concatenate([found[i] for i in keep]) >> np.uint64(32 - bits)
                n = np.zeros(len(h), np.int64)
                if len(last):
                    at = np.minimum(np.searchsorted(last, h), len(last) - 1)
                    n = np.where(last[at] == h, count[at], 0)
                picked, at = [], 0
                for i in keep:
                    size = len(found[i])
                    k = size - -(-percent * size // 100) + 1
                    order = np.argsort(n[at : at + size], kind="stable")[:k] if n[at : at + size].any() else np.arange(k)
                    picked.append(order + at)
                    at += size
                of = np.repeat(nodes[keep], [len(x) for x in picked])
                picked = np.concatenate(picked)
                h, hot = h[picked], n[picked] >= HOT
                e = np.empty(len(h), _ENTRY)
                e["h"], e["node"] = h & np.uint64(0xFFFFFFFF), of
                part = (h >> np.uint64(32)).astype(np.int64)
                parts, (entries,) = _dealt(part[~hot], e[~hot])
                yield pa.record_batch([pa.array(parts, pa.int32()), pa.array(entries, pa.binary()), pa.array([False] * len(parts), pa.bool_())], ["part", "entries", "hot"])
                pair = np.column_stack([h[hot], of[hot]])
                parts, (entries,) = _dealt((_text.mix(pair[:, 1]) % np.uint64(1 << bits)).astype(np.int64), pair)
                yield pa.record_batch([pa.array(parts, pa.int32()), pa.array(entries, pa.binary()), pa.array([True] * len(parts), pa.bool_())], ["part", "entries", "hot"])

    def rows(region, node):
        return pa.record_batch([pa.array(region.astype(np.int64)), pa.array(node.view(np.int64))], ["region", "node"])

    def gather(batches):
        held, keys = [], []
        for b in batches:
            for p, e, hot in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if hot:
                    pair = np.frombuffer(e, "<u8").reshape(-1, 2)
                    yield rows(pair[:, 0].copy(), pair[:, 1].copy())
                else:
                    e = np.frombuffer(e, _ENTRY)
                    keys.append(e["h"].astype(np.int64) | p << 32)
                    held.append(e["node"])
        if not held:
            return
        h, node = np.concatenate(keys), np.concatenate(held)
        keys.clear(), held.clear()
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node = h[new], node[new]
        first = np.flatnonzero(np.diff(h, prepend=-1))
        size = np.diff(np.append(first, len(h)))
        name = np.add.reduceat(_text.mix(node ^ np.uint64(0x9E3779B97F4A7C15)), first) + size.astype(np.uint64)
        _, once = np.unique(name, return_index=True)  # neighbouring shingles of one passage have the same nodes
        use = np.zeros(len(first), bool)
        use[once] = True
        use &= size > 1
        take = np.repeat(use, size)
        yield rows(np.repeat(name, size)[take].view(np.int64), node[take])

    dealt = docs.mapInArrow(prefixes, "part int, entries binary, hot boolean").repartition(tasks, "part")
    return dealt.mapInArrow(gather, "region long, node long").distinct()


def groups(batches, keys: int):
    """(key, table) of every run of rows with equal first columns, for rows in their order."""
    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy() for i in range(keys)]
        cut = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()
        for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
            this = tuple(int(c[lo]) for c in columns)
            if held and this != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = this
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _counts(sketches: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(sketches), -1).astype(np.int16)


def possible(sizes: np.ndarray, sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of places that sketches do not rule out; no linked pair is ever ruled out."""
    comp, out = np.arange(len(sizes)), []
    bits = np.array([_bits(n) for n in sizes.tolist()])
    for b in sorted(set(bits.tolist())):
        own, finer = np.flatnonzero(bits == b), np.flatnonzero(bits == b + 1)
        at = np.concatenate([own, finer])
        counts = _counts([sketches[i] for i in own])
        if len(finer):
            counts = np.concatenate([counts, _counts([sketches[i] for i in finer]).reshape(len(finer), -1, 2).sum(2, dtype=np.int16)])
        n = sizes[at]
        for k in range(len(own)):
            rest = at[k + 1 :]
            if not (comp[rest] != comp[at[k]]).any():
                continue
            apart = np.maximum(np.abs(counts[k + 1 :] - counts[k]).sum(1, dtype=np.int64), np.abs(n[k + 1 :] - n[k]))
            total = n[k + 1 :] + n[k]
            for j in rest[(total - apart) * (100 + percent) >= 2 * percent * total]:
                if comp[j] != comp[at[k]]:
                    out.append((int(at[k]), int(j)))
                    comp[comp == comp[j]] = comp[at[k]]
    return out


def hanging(met: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between nodes of a region that may be linked; nodes of a region of more than LEAF nodes all hang together."""
    sizes = met.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("least"))
    large = F.broadcast(sizes.filter(F.col("m") > LEAF))  # at most one to LEAF entries
    whole = met.join(large, "region").select(F.col("node").alias("a"), F.col("least").alias("b"))

    def work(batches):
        for _, t in groups(batches, 1):
            node, n = t.column("node").to_pylist(), t.column("n").to_numpy()
            yield _links([(node[i], node[j]) for i, j in possible(n, t.column("sketch").to_pylist(), percent)])

    small = met.join(large, "region", "left_anti").join(outlines.select("node", "n", "sketch"), "node").select("region", "node", "n", "sketch")
    return small.repartition("region").sortWithinPartitions("region").mapInArrow(work, "a long, b long").unionByName(whole)


def connected(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between places that unite all linked sets of different labels; only sets of different components are compared."""
    size = np.array([len(s) for s in sets])
    _, inv = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    _, comp = np.unique(labels, return_inverse=True)
    mark, waits, out = np.zeros(inv.max() + 1, bool), np.ones(len(sets), bool), []
    while True:
        left = np.flatnonzero(waits)
        many = np.bincount(comp[left]) if len(left) else np.zeros(0)
        if np.count_nonzero(many) < 2:
            return out
        i = left[comp[left] != many.argmax()][0]
        waits[i] = False
        own = inv[first[i] : first[i] + size[i]]
        mark[own] = True
        common = np.add.reduceat(mark[inv].astype(np.int64), first)
        mark[own] = False
        for j in np.flatnonzero((100 * common >= percent * (size + size[i] - common)) & (comp != comp[i])):
            if comp[j] != comp[i]:
                out.append((int(i), int(j)))
                comp[comp == comp[j]] = comp[i]


def leaves(cells: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of cells (cell, node, label, p) of bounded size."""

    def work(batches):
        for _, t in groups(batches, 1):
            node = t.column("node").to_pylist()
            if len(node) > 1:
                yield _links([(node[i], node[j]) for i, j in connected([_unpack(p) for p in t.column("p").to_pylist()], t.column("label").to_numpy(), percent)])

    rows = cells.select("cell", "node", "label", "p").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(work, "a long, b long")


def measured(cells: DataFrame, level: int, percent: int) -> DataFrame:
    """(cell, node, home, near, linked) of large cells (cell, node, p): the nearest pivot, those within the window, and those linked."""
    luck = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 40)) / float(1 << 40)
    cells = cells.withColumn("luck", luck)
    wanted = F.least(F.greatest(F.ceil(F.count(F.lit(1)) / TO_PIVOT), F.lit(FEWEST)), F.lit(MOST_PIVOTS))
    stats = cells.groupBy("cell").agg(F.greatest(wanted / F.count(F.lit(1)), F.min("luck")).alias("below"), F.ceil(F.count(F.lit(1)) / LEAF).cast("int").alias("salts"))
    cells = cells.join(F.broadcast(stats), "cell")  # large cells only: at most one row to LEAF nodes
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt")
    rows = cells.select("cell", salt, F.lit(1).alias("kind"), "node", "p")
    pivots = cells.filter(F.col("luck") <= F.col("below")).select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "node", "p")
    r2 = 2 * (1 - percent / 100) + 1e-9

    def work(batches):
        for (cell, _), t in groups(batches, 2):
            kind, node = t.column("kind").to_numpy(), t.column("node").to_numpy()
            sets, k = [_unpack(p) for p in t.column("p").to_pylist()], int((kind == 0).sum())
            data = np.concatenate(sets[:k])
            of = np.repeat(np.arange(k), [len(s) for s in sets[:k]])
            order = np.argsort(data, kind="stable")
            data, of, size = data[order], of[order], np.array([len(s) for s in sets[:k]])
            out = []
            for x, s in zip(node[k:].tolist(), sets[k:]):
                lo, hi = np.searchsorted(data, s), np.searchsorted(data, s, "right")
                many = hi - lo
                at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                common = np.bincount(of[at], minlength=k)
                d = 1 - common / (size + len(s) - common)
                home = int(d.argmin())
                linked = 100 * common >= percent * (size + len(s) - common)
                out.append((cell, x, int(node[home]), node[:k][d <= d[home] + r2].tolist(), node[:k][linked & (node[:k] != x)].tolist()))
            types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
            yield pa.record_batch([pa.array(c, y) for c, y in zip(zip(*out) if out else [[]] * 5, types)], ["cell", "node", "home", "near", "linked"])

    dealt = rows.unionByName(pivots).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    return dealt.mapInArrow(work, "cell long, node long, home long, near array<long>, linked array<long>")


def _sized(cells: DataFrame) -> DataFrame:
    """Cells (cell, node, label, n, ...) with m, shingles and whether they have more than one label; single-label cells are gone."""
    stats = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"), (F.min("label") < F.max("label")).alias("several"))
    large = (F.col("m") > LEAF) | (F.col("shingles") > LEAF_SHINGLES)
    return stats.filter("several").select("cell", "m", large.alias("large"))


def _labelled(cells: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links)
    return cells.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _blocks(cells: DataFrame, stats: DataFrame) -> DataFrame:
    """Cells cut into blocks in which every node outside the greatest component meets all others."""
    size = LEAF // 2
    per = F.broadcast(stats.select("cell"))
    cells = cells.join(per, "cell")
    labels = cells.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    tops = labels.groupBy("cell").agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.max("k").alias("core"), F.sum("k").alias("m"), F.sum("s").alias("s"))
    weight = F.greatest(F.lit(1.0), F.col("s") / F.col("m") * LEAF / LEAF_SHINGLES)  # blocks of long sets have fewer
    tops = tops.select("cell", "top", F.ceil(F.col("core") * weight / size).cast("int").alias("bc"), F.ceil((F.col("m") - F.col("core")) * weight / size).cast("int").alias("bn"))
    cells = cells.join(F.broadcast(tops), "cell")
    inside = F.col("label") == F.col("top")
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.when(inside, F.col("bc")).otherwise(F.col("bn"))).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    cells = cells.withColumn("own", own)
    core = F.transform(each(F.col("bn")), lambda j: F.struct(F.lit(0).alias("t"), F.col("own").alias("i"), j.alias("j")))
    met = F.transform(each(F.col("bc")), lambda i: F.struct(F.lit(0).alias("t"), i.alias("i"), F.col("own").alias("j")))
    among = F.transform(each(F.col("bn")), lambda j: F.struct(F.lit(1).alias("t"), F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j")))
    where = F.when(inside, core).otherwise(F.concat(met, among))
    cells = cells.select("cell", "node", "label", "n", F.explode(where).alias("w"))
    return cells.select(F.xxhash64("cell", "w.t", "w.i", "w.j").alias("cell"), "node", "label", "n")


def joined(cells: DataFrame, payload: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that unite all linked nodes of cells (cell, node, n); payload has each node's set."""
    cells, links = cells.withColumn("label", F.col("node")), None
    for level in range(LEVELS):
        stats = written(_sized(cells))
        small = cells.join(stats.filter("not large").select("cell"), "cell", "left_semi")
        found = written(leaves(small.join(payload, "node"), percent))
        links = found if links is None else links.unionByName(found)
        large = stats.filter("large")
        if not large.limit(1).count():
            return links
        cells = written(cells.join(F.broadcast(large.select("cell", F.col("m").alias("before"))), "cell"))
        apart = written(measured(cells.join(payload, "node").select("cell", "node", "p"), level, percent))
        links = links.unionByName(apart.select(F.col("node").alias("a"), F.explode("linked").alias("b")))
        cells = written(_labelled(cells.join(apart.drop("linked"), ["cell", "node"]), links))
        tops = cells.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cell").agg(F.max_by("label", F.struct("k", "label")).alias("top"))
        cells = cells.join(F.broadcast(tops), "cell")
        where = F.when(F.col("label") == F.col("top"), F.array("home")).otherwise(F.col("near"))
        children = cells.select("node", "n", "label", "before", "cell", F.explode(where).alias("pivot"))
        children = written(children.select(F.xxhash64("cell", "pivot").alias("child"), "cell", "node", "n", "label", "before"))
        parents = cells.select("cell", "node", "n", "label", "before")
        grown = children.groupBy("cell", "child").agg(F.count(F.lit(1)).alias("m"), F.first("before").alias("before")).groupBy("cell").agg((F.max("m") > 0.7 * F.max("before")).alias("stuck"))
        stuck = written(grown.filter("stuck")) if level < LEVELS - 1 else written(grown)
        blocks = _blocks(parents, stuck)
        found = written(leaves(blocks.join(written(_sized(blocks)).select("cell"), "cell", "left_semi").join(payload, "node"), percent))
        links = links.unionByName(found)
        cells = written(_labelled(children.join(F.broadcast(stuck), "cell", "left_anti").drop("cell", "before").withColumnRenamed("child", "cell"), links))
    return links


def labelled(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, row if there is one, n_shingles, node and label of every document; rows with words and one label are one component."""
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in docs.columns if c == "row"])
    named = saved(members(docs, width))
    docs = docs.select("doc_id", "text")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = max(least, int(1 + total // ENTRIES))
    bits = min(max(int(8 * tasks - 1).bit_length(), 4), 24)
    outlines = named.filter("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.coalesce(F.min("doc_id"), F.lit(-1)).alias("holder"))
    outlines = written(outlines)
    met = written(regions(docs, width, percent, bits, tasks, frequent(docs, width, bits, tasks)))
    cells = components(hanging(met, outlines, percent))
    cells = written(cells.join(outlines.select("node", "n", "holder"), "node").select(F.col("label").alias("cell"), "node", "n", F.col("node").bitwiseXOR(F.shiftleft("holder", 37)).alias("key")))
    filter_ = spark.sparkContext.broadcast(bitmap(cells.select("key"), cells.count()))

    def emit(batches):
        for batch in batches:
            for ids, found, nodes in _sets(batch, width):
                key = nodes ^ (ids.fill_null(-1).to_numpy().astype(np.uint64) << np.uint64(37))
                use = maybe(key, filter_.value)
                rows = [i for i in _distinct(found, nodes) if use[i]] if use.any() else []
                yield pa.record_batch([pa.array(nodes[rows].view(np.int64)), pa.array([_pack(found[i]) for i in rows], pa.binary())], ["node", "p"])

    payload = docs.mapInArrow(emit, "node long, p binary").join(cells.select("node"), "node", "left_semi").dropDuplicates(["node"])
    links = joined(cells.drop("key"), written(payload), percent)
    salted = components(links).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = named.drop("sketch").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return named.join(salted, ["node", "salt"], "left").withColumn("label", F.coalesce("label", "node")).drop("salt")


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    full = written(labelled(docs.select("doc_id", "text"), width, percent))
    least = full.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    full = full.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(least, ["label", "salt"], "left")
    return full.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
