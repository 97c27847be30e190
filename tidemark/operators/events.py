"""Event streams at rest: order, duplicates, identities, elapsed time and trading sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(events: DataFrame, by: str, kinds: list[str], kind: str, *keys: str) -> DataFrame:
    """Each event's place in its group: by the rank of its kind, unknown kinds last, then by keys."""
    rank = F.coalesce(F.when(F.col(kind).isNotNull(), F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))), F.lit(0))
    order = W.partitionBy(by).orderBy(F.when(rank > 0, rank).otherwise(len(kinds) + 1), *keys)
    return events.withColumn("place", F.row_number().over(order).cast("long"))


def duplicates(events: DataFrame, content: list[str], order: str) -> DataFrame:
    """Each event with the first one of equal content; null for first occurrences."""
    same = W.partitionBy(*content)
    first = F.min(order).over(same)
    return events.withColumn("first_occurrence", F.when(F.col(order) != first, first))


def observation_id(event_id: Column, scope: Column, sequence: Column, file: Column, row: Column, ingestion: Column) -> Column:
    """A stable id from the best identity at hand: the provider's, a scoped sequence, a place in a file, or the ingestion; never from content."""
    sized = lambda x: F.concat(F.length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string"))  # noqa: E731  so that no two lists of parts meet
    tagged = lambda tag, *c: F.concat_ws("|", F.lit(tag), *map(sized, c))
    found = (
        F.when(event_id.isNotNull(), tagged("event", event_id)).when(scope.isNotNull() & sequence.isNotNull(), tagged("sequence", scope, sequence))
        .when(file.isNotNull() & row.isNotNull(), tagged("row", file, row)).when(ingestion.isNotNull(), tagged("ingestion", ingestion))
    )
    return F.sha2(found, 256)


def remaining(steps: DataFrame, by: str, order: str, fraction: str, maturity: Column) -> DataFrame:
    """Elapsed years up to each step and what is left to a maturity, never below zero."""
    so_far = F.sum(fraction).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return steps.withColumn("elapsed", so_far).withColumn("remaining", F.greatest(maturity - F.col("elapsed"), F.lit(0.0)))


def sessions(ranges: DataFrame, first: str, last: str, holidays: list[str] | None = None) -> DataFrame:
    """One row per weekday of each range that is no holiday, numbered within the range by `session`; a reversed range has none."""
    span = F.when(F.col(first) <= F.col(last), F.sequence(F.col(first), F.greatest(F.col(first), F.col(last))))
    days = F.filter(span, lambda d: (F.weekday(d) < 5) & ~d.cast("string").isin(holidays or [""]))
    return ranges.select("*", F.posexplode(days).alias("session", "session_date"))


def decisions(days: DataFrame, times: list[str], by: str | None, entry: str, zone: str, periods: int = 252) -> DataFrame:
    """The decision times of each range's sessions (`sessions` gives session and session_date), numbered by `step`: the first session begins at the entry time.

    decision_at is the moment of the local time in its zone, years the part of a year since the decision before: 0 at first.
    Without `by` each range has all its sessions as `sessions` numbers them, so its steps follow from those numbers; with it,
    the rows of a key are gathered and numbered, also where sessions are left out.
    """
    if entry not in times or times != sorted(set(times)):
        raise ValueError("times are distinct, in order, and hold the entry")
    rows = days.select("*", F.posexplode(F.array(*map(F.lit, times))).alias("decision", "local_time")).filter((F.col("session") > 0) | (F.col("local_time") >= entry))
    if by is None:
        step = (F.col("session") * len(times) + F.col("decision") - times.index(entry)).cast("int")
    else:
        step = F.row_number().over(W.partitionBy(by).orderBy("session", "decision")) - 1
    minutes = [60 * int(t[:2]) + int(t[3:]) for t in times]
    local = F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.get(F.array(*map(F.lit, minutes)), F.col("decision")))
    moment = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return rows.withColumn("step", step).withColumn("decision_at", moment).withColumn("years", F.when(F.col("step") == 0, 0.0).otherwise(1.0 / (periods * len(times))))


def expiries(entries: DataFrame, entry: str, remaining: str, holidays: list[str] | None = None, periods: int = 252) -> DataFrame:
    """Each entry with `expiry_date`, the session so many sessions after the entry's, and the years up to it; null where none remains.

    The entry's day counts as the first session, or the next weekday that is no holiday. Twice the sessions and all holidays are days enough.
    """
    closed = holidays or []
    span = F.sequence(F.col(entry), F.date_add(F.col(entry), (F.col(remaining) * 2 + 7 + len(closed) * 3).cast("int")))
    open_ = F.filter(span, lambda d: (F.weekday(d) < 5) & ~d.cast("string").isin(closed or [""]))
    fine = F.col(remaining) > 0
    return entries.withColumn("expiry_date", F.when(fine, F.get(F.when(fine, open_), F.col(remaining).cast("int")))).withColumn("years_to_expiry", F.when(fine, F.col(remaining) / periods))
