"""Look-ups over stored records: contracts, bindings, members, resolved subjects, appended prices and immutable inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(records: DataFrame, key: str, clock: str, tie: str) -> DataFrame:
    """The latest record of each key, the least `tie` among equal times."""
    order = W.partitionBy(key).orderBy(F.col(clock).desc(), tie)
    return records.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def contracts(versions: DataFrame, futures: DataFrame, options: DataFrame, instrument: str, underlying, expiry) -> DataFrame:
    """The versions whose instrument is a future or an option (instrument, underlying, expiry) of that underlying and expiry."""
    of = lambda frame: frame.filter((F.col("underlying") == underlying) & (F.col("expiry") == expiry)).select(instrument)
    return versions.join(of(futures).unionByName(of(options)), instrument, "left_semi")


def bindings(mappings: DataFrame, key: str, instrument: str) -> DataFrame:
    """The instrument each provider key was ever bound to; null and `corrupt` where there were several."""
    out = mappings.groupBy(key).agg(F.min(instrument).alias("_least"), F.max(instrument).alias("_most"))
    return out.select(key, F.when(F.col("_least") == F.col("_most"), F.col("_least")).alias(instrument), (F.col("_least") != F.col("_most")).alias("corrupt"))


def members(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """The rows whose key is wanted, each once however often it is wanted."""
    return rows.join(wanted.select(*key), list(key), "left_semi")


def subjects(keys: DataFrame, mappings: DataFrame, versions: DataFrame, key: str, instrument: str) -> DataFrame:
    """Each distinct key with its instrument and version, or the reason why there is none.

    mappings (key, instrument, visible) and versions (instrument, version_id, visible): `visible` says whether a row holds at both cutoffs.
    Mappings may name their version_id: then it must be the one found. Reasons: unknown_provider_key, stale_provider_mapping,
    ambiguous_provider_mapping, ambiguous_contract_version, mapping_of_other_version.
    """
    named = F.col("version_id") if "version_id" in mappings.columns else F.lit(None)
    mappings = mappings.withColumn("_named", named)
    seen = F.col("visible")
    m = mappings.groupBy(key).agg(F.count_if(seen).alias("_m"), F.min(F.when(seen, F.col(instrument))).alias(instrument), F.min(F.when(seen, F.col("_named"))).alias("_named"), F.lit(True).alias("_known"))
    v = versions.filter(seen).groupBy(instrument).agg(F.count(F.lit(1)).alias("_v"), F.min("version_id").alias("version_id"))
    out = keys.select(key).distinct().join(m, key, "left").join(v, instrument, "left")
    reason = (
        F.when(F.col("_known").isNull(), "unknown_provider_key").when(F.col("_m") == 0, "stale_provider_mapping").when(F.col("_m") > 1, "ambiguous_provider_mapping")
        .when(F.col("_v").isNull(), "stale_provider_mapping").when(F.col("_v") > 1, "ambiguous_contract_version")
        .when(F.col("_named") != F.col("version_id"), "mapping_of_other_version")
    )
    good = reason.isNull()
    return out.select(key, F.when(good, F.col(instrument)).alias(instrument), F.when(good, F.col("version_id")).alias("version_id"), reason.alias("reason"))


def overlay(prices: DataFrame, live: DataFrame) -> DataFrame:
    """The prices with one provisional row for each instrument whose live price (instrument_id, session_date, price) is positive and after its last session."""
    last = prices.groupBy("instrument_id").agg(F.max("session_date").alias("_last"))
    fresh = live.filter("price > 0").join(last, "instrument_id").filter("session_date > _last")
    row = fresh.select("instrument_id", "session_date", "price", F.lit(True).alias("provisional"))
    return prices.select("instrument_id", "session_date", "price", F.lit(False).alias("provisional")).unionByName(row)


def inserts(stored: DataFrame, incoming: DataFrame, key: str, *content: str) -> DataFrame:
    """Each incoming key once: `new`, `same` where the stored row has equal content, `collision` where it or another incoming row differs."""
    body = F.struct(*content)
    come = incoming.groupBy(key).agg(F.min(body).alias("_come"), F.max(body).alias("_most"))
    out = come.join(stored.select(key, body.alias("_held"), F.lit(True).alias("_stored")), key, "left")
    state = F.when(~F.col("_come").eqNullSafe(F.col("_most")), "collision").when(F.col("_stored").isNull(), "new").when(F.col("_come").eqNullSafe(F.col("_held")), "same").otherwise("collision")
    return out.select(key, "_come.*", state.alias("outcome"))
