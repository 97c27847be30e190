"""Digests of whole tables and of results with their members, by which stored copies are compared without sorting anything globally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import canonical


def _half(digest: Column, at: int) -> Column:
    """Sixteen hex digits of a digest as a number."""
    return F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")


def table_digest(rows: DataFrame, *by: str) -> DataFrame:
    """One row (for each group): the number of rows, of distinct rows, and two sums of 64 bits of the rows' hashes each.

    It is that of the multiset: equal for any order and partitioning, merged by adding, and another one if a row is doubled,
    missing or changed in a byte. Rows are hashed by their canonical JSON, columns by name, so order of columns doesn't count.
    """
    own = [f for f in rows.schema if f.name not in by]
    body = canonical.json_text(F.struct(*(F.col(f"`{f.name}`") for f in own)), T.StructType(own))
    hashed = rows.select(*by, F.sha2(F.coalesce(body, F.lit("no canonical form")), 256).alias("_h"), F.lit(1).cast("long").alias("_n"))
    # equal rows meet first, so that each distinct row is converted once
    each = hashed.groupBy(*by, "_h").agg(F.sum("_n").alias("_n"))
    total = lambda at: F.coalesce(F.sum((_half(F.col("_h"), at) * F.col("_n")).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return each.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), total(1).alias("sum_high"), total(17).alias("sum_low"))


def membership(results: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Each result with its members in order and `fault`, what its stored proof and its members disagree on, or null.

    results: key, member_count, member_digest (of the member ids in order, one a line). members: key, ordinal (from 1), member_id.
    Faults in this order: unknown_result (members without a result), missing_members, extra_members, doubled_member,
    broken_order (ordinals aren't 1 to n), other_members. One grouping by key; a result's members are gathered in one group.
    """
    held = members.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "member_id"))).alias("_m"))
    out = results.withColumn("_known", F.lit(True)).join(held, key, "full")
    own = F.coalesce("_m", F.array().cast(held.schema["_m"].dataType))
    ids = F.transform(own, lambda m: m["member_id"].cast("string"))
    n, count = F.size(own), F.col("member_count")
    ordinals = F.transform(own, lambda m: m["ordinal"].cast("long"))
    want = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    digest = F.sha2(F.array_join(ids, "\n"), 256)
    fault = (
        F.when(F.col("_known").isNull(), "unknown_result").when(n < count, "missing_members").when(n > count, "extra_members").when(F.size(F.array_distinct(ids)) < n, "doubled_member")
        .when(ordinals != want, "broken_order").when(~digest.eqNullSafe(F.col("member_digest")), "other_members")
    )
    return out.select(key, ids.alias("members"), digest.alias("computed_digest"), fault.alias("fault"))
