"""Bitemporal states at many cutoffs at once: chains of records become rectangles of market by knowledge time, joined with the cutoffs.

Records: record_id, scope_id, supersedes_record_id, recorded_at, valid_from, valid_until. Within a chain the market's axis is
cut where validities begin or end; in each part the records that cover it hold one after the other, by recording. So a
cutoff lies in at most one rectangle of a chain, and the answer equals that of `bitemporal.resolve` at its moment.

A chain that breaks a rule (see `bitemporal.violations`) makes its scope corrupt from the moment the break was known: states
fail closed instead of answering. A null known_as_of knows all. A chain of m records gives m rectangles for each of its
parts at most; chains are versions of one instrument or key and short.

Chains lie within their scopes (what points elsewhere is a break), so rows are exchanged by scope once and followed there:
the records of one scope are gathered in one row, and each row of a chain carries the ends of the chain's validities.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bitemporal import violations
from tidemark.operators.intervals import covering
from tidemark.workers import importable

_NEVER = "timestamp '9999-12-31 00:00:00'"


def _followed(ids: list, targets: list, micros: list, kinds: list) -> list[dict]:
    """The root of each record of one scope, and whether it points at an earlier record of the scope and of its kind, or at none."""
    at = {x: i for i, x in enumerate(ids)}
    root = {}
    for x in ids:
        path = []
        while x not in root:
            to = targets[at[x]] if x in at else None
            root[x] = x if to is None else to  # until the end of the path is known; it also ends a cycle
            path.append(x)
            x = root[x]
        for y in path:
            root[y] = root[x]
    out = []
    for i, x in enumerate(ids):
        j = at.get(targets[i])
        late = j is not None and micros[i] is not None and micros[j] is not None and micros[i] <= micros[j]
        out.append({"root_id": root[x], "sound": targets[i] is None or (j is not None and targets[i] != x and not late and kinds[i] == kinds[j])})
    return out


def _gathered(records: DataFrame) -> DataFrame:
    """scope_id, _r and _f: the records of each scope, and of each its root_id and sound, which is false where its pointer alone is a break."""
    importable(records.sparkSession)
    columns = records.columns
    ident = records.schema["record_id"].dataType
    found = T.ArrayType(T.StructType([T.StructField("root_id", ident), T.StructField("sound", T.BooleanType())]))

    @F.arrow_udf(returnType=found)
    def follow(ids: pa.Array, targets: pa.Array, micros: pa.Array, kinds: pa.Array) -> pa.Array:
        rows = zip(ids.to_pylist(), targets.to_pylist(), micros.to_pylist(), kinds.to_pylist())
        struct = pa.struct([("root_id", ids.type.value_type), ("sound", pa.bool_())])
        return pa.array([_followed(*row) for row in rows], pa.list_(struct))

    of = records.filter("scope_id is not null").withColumn("supersedes_record_id", F.col("supersedes_record_id").cast(ident)).groupBy("scope_id").agg(F.collect_list(F.struct(*(c for c in columns if c != "scope_id"))).alias("_r"))
    kind = (lambda r: r["kind"].cast("string")) if "kind" in columns else (lambda r: F.lit(""))
    return of.withColumn("_f", follow(F.col("_r.record_id"), F.col("_r.supersedes_record_id"), F.transform("_r", lambda r: F.unix_micros(r["recorded_at"].cast("timestamp"))), F.transform("_r", kind)))


def _rows(gathered: DataFrame) -> DataFrame:
    each = gathered.select("scope_id", F.explode(F.arrays_zip("_r", "_f")).alias("_x"))
    return each.select("scope_id", "_x._r.*", "_x._f.*")


def rectangles(records: DataFrame) -> DataFrame:
    """(scope_id, root_id, record_id, market_from, market_until, known_from, known_until), ends open where null."""
    own = W.partitionBy("scope_id", "root_id")
    ends = F.array_sort(F.array_union(F.collect_set("valid_from").over(own), F.collect_set("valid_until").over(own)))
    r = _rows(_gathered(records).repartition("scope_id")).select("scope_id", "root_id", "record_id", "recorded_at", "valid_from", "valid_until").withColumn("_ends", ends)
    parts = F.transform("_ends", lambda x, i: F.struct(x.alias("market_from"), F.get("_ends", i + 1).alias("market_until")))
    covers = lambda p: (F.col("valid_from") <= p["market_from"]) & (F.col("valid_until").isNull() | (p["market_until"] <= F.col("valid_until")))
    cells = r.withColumn("_part", F.explode(F.filter(parts, covers))).select("scope_id", "root_id", "record_id", F.col("recorded_at").alias("known_from"), "_part.market_from", "_part.market_until")
    held = W.partitionBy("scope_id", "root_id", "market_from").orderBy("known_from", "record_id")
    out = cells.withColumn("known_until", F.lead("known_from").over(held))
    out = out.filter(F.col("known_until").isNull() | (F.col("known_until") > F.col("known_from")))
    return out.select("scope_id", "root_id", "record_id", "market_from", "market_until", "known_from", "known_until")


def breaks(records: DataFrame) -> DataFrame:
    """(scope_id, broken_at): since when a scope's chains are known to be broken.

    Where no id and no pointer stands twice in the table, breaks are pointers that are not sound in their scope. Otherwise
    records of several scopes may break each other, and all are held against each other.
    """
    single = lambda c: records.groupBy(F.col(c).alias("id")).count().filter("id is not null and count > 1").select("id")
    if single("record_id").unionByName(single("supersedes_record_id")).isEmpty():
        return _rows(_gathered(records)).filter("not sound").groupBy("scope_id").agg(F.min("recorded_at").alias("broken_at"))
    return _breaks_anywhere(records)


def _breaks_anywhere(records: DataFrame) -> DataFrame:
    found = violations(records)
    own = records.select("record_id", "scope_id", "recorded_at", "supersedes_record_id")
    single = found.filter("violation <> 'branch'").join(own, "record_id").select("scope_id", "recorded_at")
    successors = own.join(found.filter("violation = 'branch'").select(F.col("record_id").alias("supersedes_record_id")).distinct(), "supersedes_record_id", "left_semi")
    second = successors.groupBy("supersedes_record_id").agg(F.array_sort(F.collect_set(F.struct("recorded_at", "record_id", "scope_id"))).alias("s")).select(F.get("s", F.lit(1)).alias("s"))
    return single.unionByName(second.select("s.scope_id", "s.recorded_at")).groupBy("scope_id").agg(F.min("recorded_at").alias("broken_at"))


def _moment(known: Column) -> Column:
    return F.coalesce(known, F.expr(_NEVER))


def states(records: DataFrame, cutoffs: DataFrame, large_scopes: bool = False) -> DataFrame:
    """(cutoff_id, scope_id, record_id, state) of cutoffs (cutoff_id, scope_id, market_as_of, known_as_of): resolved, none, ambiguous (several chains hold) or corrupt.

    A cutoff meets the rectangles of its scope. Where scopes hold thousands of records and are asked for as often, say
    large_scopes: then they meet by dyadic blocks of time, which spreads a scope and costs some twenty rows a cutoff.
    """
    asked = cutoffs.select("cutoff_id", "scope_id", "market_as_of", _moment(F.col("known_as_of")).alias("_known"))
    return _stated(asked, records, [], large_scopes).select("cutoff_id", "scope_id", "record_id", "state")


def _stated(asked: DataFrame, records: DataFrame, carried: list[str], large_scopes: bool = False) -> DataFrame:
    """record_id and state of each asked row (cutoff_id, scope_id, market_as_of, _known and carried columns, which the cutoff and scope decide)."""
    keys = ["scope_id", "cutoff_id", "market_as_of", "_known", *carried]
    known = (F.col("known_from") <= F.col("_known")) & (F.col("known_until").isNull() | (F.col("_known") < F.col("known_until")))
    # a cutoff lies in one rectangle of a chain at most, so several chains hold where the least root is not the greatest
    only = F.min("root_id").alias("_first"), F.max("root_id").alias("_last"), F.min("record_id").alias("_only")
    if large_scopes:
        met = covering(asked, rectangles(records), ["scope_id"], "market_as_of", "market_from", "market_until").filter(known)
        found = met.groupBy("scope_id", "cutoff_id").agg(*only)
        found = asked.join(found, ["scope_id", "cutoff_id"], "left")
    else:
        r = rectangles(records).withColumnRenamed("scope_id", "_scope")
        at = (F.col("scope_id") == F.col("_scope")) & (F.col("market_from") <= F.col("market_as_of")) & (F.col("market_until").isNull() | (F.col("market_as_of") < F.col("market_until"))) & known
        found = asked.join(r, at, "left").groupBy(*keys).agg(*only)
    out = found.join(breaks(records), "scope_id", "left")
    corrupt = F.coalesce(F.col("broken_at") <= F.col("_known"), F.lit(False))
    state = F.when(corrupt, "corrupt").when(F.col("_first").isNull(), "none").when(F.col("_first") < F.col("_last"), "ambiguous").otherwise("resolved")
    return out.select(*keys, F.when(state == "resolved", F.col("_only")).alias("record_id"), state.alias("state"))


def mapping_states(mappings: DataFrame, versions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The mapping of each provider key at its cutoffs, where a mapping counts only if its version is the one resolved at that cutoff.

    mappings: records whose scope is the provider key, with version_id; versions: records whose record_id is that
    version_id and whose scope is the instrument. Returns cutoff_id, scope_id, record_id, version_id, instrument_id, state;
    a corrupt or ambiguous instrument behind a known mapping of the key makes the state corrupt_version or ambiguous_version.

    A cutoff goes to each instrument once, with the mappings valid at its moment, and comes back with those that hold.
    """
    asked = cutoffs.select("cutoff_id", "scope_id", "market_as_of", _moment(F.col("known_as_of")).alias("_known")).repartition("scope_id")
    instruments = versions.select(F.col("record_id").alias("version_id"), F.col("scope_id").alias("instrument_id"))
    m = _gathered(mappings.join(instruments, "version_id", "left"))
    fields = "root_id", "recorded_at", "record_id", "version_id", "valid_from", "valid_until", "instrument_id"
    m = m.select("scope_id", F.filter(F.transform(F.arrays_zip("_r", "_f"), lambda x: F.struct(x["_f"]["root_id"], *(x["_r"][c].alias(c) for c in fields[1:]))), lambda x: x["instrument_id"].isNotNull()).alias("_m"))
    known = asked.join(m.repartition("scope_id"), "scope_id").withColumn("_m", F.filter("_m", lambda x: x["recorded_at"] <= F.col("_known")))
    each = known.withColumn("instrument_id", F.explode(F.array_distinct(F.col("_m.instrument_id"))))
    valid = lambda x: (x["valid_from"] <= F.col("market_as_of")) & (x["valid_until"].isNull() | (F.col("market_as_of") < x["valid_until"])) & (x["instrument_id"] == F.col("instrument_id"))
    each = each.withColumn("_held", F.transform(F.filter("_m", valid), lambda x: F.struct(*(x[c].alias(c) for c in fields[:4]))))
    each = each.select(F.struct("scope_id", "cutoff_id").alias("cutoff_id"), F.col("instrument_id").alias("scope_id"), "market_as_of", "_known", "_held")
    current = _stated(each, versions, ["_held"])
    good = F.filter("_held", lambda h: (F.col("state") == "resolved") & (h["version_id"] == F.col("record_id")))
    told = current.select("cutoff_id.*", F.col("scope_id").alias("instrument_id"), good.alias("_held"), (F.col("state") == "corrupt").alias("_c"), (F.col("state") == "ambiguous").alias("_a")).filter(F.col("_c") | F.col("_a") | (F.size("_held") > 0))
    told = told.repartition("scope_id").select("scope_id", "cutoff_id", "instrument_id", "_c", "_a", F.explode_outer("_held").alias("_h"))
    last = F.max(F.when(F.col("_h").isNotNull(), F.struct("_h.recorded_at", "_h.record_id", "_h.version_id", "instrument_id")))
    held = told.groupBy("scope_id", "cutoff_id", "_h.root_id").agg(last.alias("_m"), F.bool_or("_c").alias("_c"), F.bool_or("_a").alias("_a"))
    found = held.groupBy("scope_id", "cutoff_id").agg(F.count("_m").alias("_n"), F.min("_m").alias("_only"), F.bool_or("_c").alias("_c"), F.bool_or("_a").alias("_a"))
    out = asked.join(found, ["scope_id", "cutoff_id"], "left").join(breaks(mappings), "scope_id", "left")
    corrupt = F.coalesce(F.col("broken_at") <= F.col("_known"), F.lit(False))
    state = F.when(corrupt, "corrupt").when(F.col("_c"), "corrupt_version").when(F.col("_a"), "ambiguous_version").when(F.coalesce("_n", F.lit(0)) == 0, "none").when(F.col("_n") > 1, "ambiguous").otherwise("resolved")
    return out.select("cutoff_id", "scope_id", *(F.when(state == "resolved", F.col(f"_only.{c}")).alias(c) for c in ("record_id", "version_id", "instrument_id")), state.alias("state"))
