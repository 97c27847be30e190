"""Joins of intervals with points by dyadic blocks: exact, by equal keys only, whatever the lengths of the intervals.

An interval is cut into the fewest blocks of 2^level hours that begin at multiples of their size, at most two of a level. A
point lies in one block of each level, so it meets an interval in exactly one block: rows are neither lost nor doubled.
Intervals of many lengths under one key spread over many blocks instead of meeting every point of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR, LEVELS, FIRST = 3_600_000_000, 22, 2_097_152  # hours of about 239 years on either side of 1970; what lies beyond counts as the edge


def _hours(at: Column, up: bool = False) -> Column:
    micros = F.unix_micros(at)
    hours = F.ceil(micros / HOUR) if up else F.floor(micros / HOUR)
    return F.least(F.greatest(hours + FIRST, F.lit(0)), F.lit((1 << LEVELS) - (0 if up else 1)))


def blocks(start: Column, end: Column) -> Column:
    """The blocks (level, block) of [start, end); a null end never ends. Cut outwards to whole hours."""
    a = _hours(start)
    b = F.greatest(F.when(end.isNull(), F.lit(1 << LEVELS)).otherwise(_hours(end, True)), a + 1)
    shift = lambda x, i: F.call_function("shiftright", x, i)

    def of(i: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        low, high = shift((a + size - 1).cast("long"), i), shift(b.cast("long"), i)
        block = lambda at: F.struct(i.alias("level"), at.alias("block"))
        return F.array(F.when((low < high) & (low % 2 == 1), block(low)), F.when((low < high) & (high % 2 == 1), block(high - 1)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of)), lambda x: x.isNotNull())


def covering(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Each point with every span of its keys that covers it. The columns besides the keys must have different names."""
    cut = spans.withColumn("_cut", F.explode(blocks(F.col(start), F.col(end)))).select(*spans.columns, F.col("_cut.level").alias("_level"), F.col("_cut.block").alias("_block"))
    hours = _hours(F.col(at)).cast("long")
    levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda i: F.struct(i.alias("level"), F.call_function("shiftright", hours, i).alias("block")))
    spread = points.withColumn("_at", F.explode(levels)).select(*points.columns, F.col("_at.level").alias("_level"), F.col("_at.block").alias("_block"))
    met = spread.join(cut, [*keys, "_level", "_block"]).filter((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end))))
    return met.drop("_level", "_block")
