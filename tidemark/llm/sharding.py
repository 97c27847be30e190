"""Sharding through fixed virtual slots.

Records hash into thousands of slots; bytes are summed per slot; a versioned slot-to-shard map spreads
the slots. Rebalancing edits the map, never the hash. Only DataFrame functions touch the records.

Null text counts as empty, a null id hashes like any other value, repeated rows are separate records, texts
of any length are one record, equal records are placed in any order, slots of equal size go by their number,
an empty table gives an empty result, and further columns are left out.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import saved, table

SLOTS = 8192


def sized(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def slot_map(stats: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(version, virtual_slot, shard, first): slots by falling bytes go to the lightest shard; `first` is the place of the slot's first record.

    The input has one row per slot, so at most SLOTS rows, whatever the data.
    """
    heap, filled, out = [(0, s) for s in range(shards)], [0] * shards, []
    for r in sorted(stats.collect(), key=lambda r: (-r["bytes"], r["virtual_slot"])):
        size, s = heapq.heappop(heap)
        out.append((version, r["virtual_slot"], s, filled[s]))
        filled[s] += r["n"]
        heapq.heappush(heap, (size + r["bytes"], s))
    return stats.sparkSession.createDataFrame(out, "version int, virtual_slot int, shard int, first long")


def rebalance(current: DataFrame, stats: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version of a map: slots leave the heaviest shard for the lightest until sizes are within the tolerance; all others stay."""
    sizes = {r["virtual_slot"]: (r["bytes"], r["n"]) for r in stats.collect()}
    old = {r["virtual_slot"]: (r["shard"], r["version"]) for r in current.collect()}
    where = {v: old[v][0] if v in old else v % shards for v in sizes}
    load = [0] * shards
    for v, s in where.items():
        load[s] += sizes[v][0]
    goal = sum(load) / shards if shards else 0
    while load and max(load) > goal * (1 + tolerance):
        hi, lo = load.index(max(load)), load.index(min(load))
        fit = [v for v, s in where.items() if s == hi and 0 < sizes[v][0] < load[hi] - load[lo]]
        if not fit:
            break
        v = max(fit, key=lambda v: (min(sizes[v][0], (load[hi] - load[lo]) - sizes[v][0]), -v))
        where[v] = lo
        load[hi] -= sizes[v][0]
        load[lo] += sizes[v][0]
    filled, out, version = [0] * shards, [], 1 + max((v for _, v in old.values()), default=0)
    for v in sorted(where):
        out.append((version, v, where[v], filled[where[v]]))
        filled[where[v]] += sizes[v][1]
    return current.sparkSession.createDataFrame(out, "version int, virtual_slot int, shard int, first long")


def place(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each record's shard and its gapless place there. The map has at most SLOTS rows, so it is broadcast."""
    order = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("rank", F.row_number().over(order)).join(F.broadcast(mapping), "virtual_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(sized(table(spark, sf_dir, "documents")))
    return place(rows, slot_map(slot_bytes(rows), 24))
