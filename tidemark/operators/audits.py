"""Audits of ordered, counted and superseding records: each returns the rows that break a rule, or a digest to compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordinal_gaps(rows: DataFrame, by: str, ordinal: str, *order: str) -> DataFrame:
    """Rows whose stored ordinal is not their place in order."""
    place = F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long")
    return rows.withColumn("expected", place).filter(~F.col(ordinal).eqNullSafe(F.col("expected")))


def order_differences(expected: DataFrame, actual: DataFrame, on: list[str], value: str) -> DataFrame:
    """Full outer comparison: keys whose values differ or that one side lacks."""
    a, b = expected.select(*on, F.col(value).alias("expected")), actual.select(*on, F.col(value).alias("actual"))
    return a.join(b, on, "full").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def false_duplicates(rows: DataFrame, key: str, first: str) -> DataFrame:
    """Rows that name a first occurrence which does not exist or is itself a duplicate."""
    target = rows.select(F.col(key).alias(first), F.col(first).alias("again"), F.lit(True).alias("there"))
    return rows.filter(F.col(first).isNotNull()).join(target, first, "left").filter("there is null or again is not null").drop("again", "there")


def digests(rows: DataFrame, by: str, ordinal: str, name: Column) -> DataFrame:
    """Per group the count, first and last ordinal, names in order, names sorted by bytes, and a hash of the ordered names."""
    items = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), name.cast("string").alias("n"))))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ordinal).alias("first_ordinal"), F.max(ordinal).alias("last_ordinal"), items.alias("items"))
    names = F.transform("items", lambda x: x["n"])
    return out.select(by, "n_rows", "first_ordinal", "last_ordinal", F.array_join(names, ",").alias("ordered"), F.array_join(F.array_sort(names), ",").alias("by_bytes"), F.sha2(F.array_join(names, ","), 256).alias("digest"))


def counts(rows: DataFrame, by: str, key: str, marked: Column) -> DataFrame:
    """Per group all rows, marked ones, others and distinct keys."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(marked).alias("n_marked"), F.count_if(~marked).alias("n_other"), F.count_distinct(key).alias("n_keys"))


def declared_counts(parents: DataFrame, children: DataFrame, key: str, declared: str) -> DataFrame:
    """Parents whose declared number of children is not the number found."""
    found = children.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    return parents.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).filter(~F.col(declared).eqNullSafe(F.col("found")))


def exclusive_subtypes(parents: DataFrame, key: str, kind: str, subtypes: dict[str, DataFrame]) -> DataFrame:
    """Parents that do not have exactly one row in the table of their kind and none in the others."""
    out = parents.select(key, kind)
    for name, rows in subtypes.items():
        out = out.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}")), key, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    right = F.lit(True)
    for name in subtypes:
        right = right & (F.col(f"n_{name}") == F.when(F.col(kind) == name, 1).otherwise(0))
    return out.filter(~right)


def disappeared(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    return before.join(now, key, "left_anti")


def differences(before: DataFrame, now: DataFrame, key: str, content: str, mapping: str) -> DataFrame:
    """Each key of either catalogue with what became of it."""
    a = before.select(key, F.col(content).alias("c0"), F.col(mapping).alias("m0"), F.lit(True).alias("was"))
    b = now.select(key, F.col(content).alias("c1"), F.col(mapping).alias("m1"), F.lit(True).alias("is"))
    category = (
        F.when(F.col("is").isNull(), "disappeared").when(F.col("was").isNull(), "added")
        .when(~F.col("c0").eqNullSafe(F.col("c1")), "metadata_changed").when(~F.col("m0").eqNullSafe(F.col("m1")), "provider_mapping_changed").otherwise("unchanged")
    )
    return a.join(b, key, "full").select(key, category.alias("category"))


def conflicts(rows: DataFrame, key: str, *content: str) -> DataFrame:
    """Keys that occur with different contents; identical repeats are no conflict."""
    print_ = F.sha2(F.to_json(F.struct(*content)), 256)
    return rows.groupBy(key).agg(F.count_distinct(print_).alias("n_contents")).filter("n_contents > 1")


def failed_scopes(failures: DataFrame, by: str, *scope: str) -> DataFrame:
    """Per group how many different entries failed, however often each did; entries are named by their scope, nulls by themselves."""
    return failures.groupBy(by).agg(F.count_distinct(F.struct(*scope)).alias("n_scopes"))
