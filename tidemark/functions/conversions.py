"""Small conversions of provider fields and stable hashes, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_millis(value: Column, zero_is_none: bool = True) -> Column:
    at = F.timestamp_millis(value.cast("long"))
    return F.when(value != 0, at) if zero_is_none else at


#: The last millisecond of the year 9999, and the last one that a timestamp can hold.
YEAR_9999, LAST_MILLIS = 253_402_300_799_999, 9_223_372_036_854_775


def epoch_time(value: Column, last: int = YEAR_9999) -> Column:
    """Seconds since the epoch, or milliseconds where the number is too great for seconds; null beyond the last millisecond."""
    millis = F.when(value > 10_000_000_000, value).otherwise(value * 1000)
    return F.timestamp_millis(F.when(F.abs(millis) <= last, millis).try_cast("long"))


def price_decimal(value: Column) -> Column:
    """A price as an exact decimal; null where it is negative or not finite, or 38 digits with 18 places cannot hold it exactly."""
    exact = F.when((value >= 0) & (value < float("inf")), value.cast("string")).try_cast("decimal(38,18)")
    return F.when(exact.cast("double") == value, F.abs(exact))


def price_fault(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "not_finite").when(value < 0, "negative").when(price_decimal(value).isNull(), "out_of_range")


def expiry_date(millis: Column, zone: str = "Asia/Kolkata") -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(millis.cast("long")), zone))


def tick_size(paise: Column) -> Column:
    return paise.cast("decimal(18,4)") / F.lit(100)


def segment(key: Column) -> Column:
    return F.split_part(key, F.lit("|"), F.lit(1))


def market_status(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.contains("pre"), "pre_open").when(low.contains("open"), "open").when(low.contains("close"), "closed").otherwise("unknown")


def identifier_fault(value: Column, most: int) -> Column:
    """What is wrong with a provider's identifier, or null."""
    return F.when(value.isNull() | (value == ""), "empty").when(F.octet_length(value) > most, "too_long").when(value.rlike(r"(?U)^\s|\s$"), "outer_whitespace").when(value.rlike(r"[\x00-\x1F\x7F]"), "control_character")


def csv_list(value: Column, allowed: list[str]) -> Column:
    """Distinct trimmed entries in their order; null if one is not allowed."""
    parts = F.array_distinct(F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(F.array_except(parts, F.array(*map(F.lit, allowed)))) == 0, parts)


def canonical(**fields: Column) -> Column:
    """Compact JSON with sorted keys; numbers, times and texts as strings, nulls as null. For texts without control characters."""

    def quoted(c: Column) -> Column:
        text = F.regexp_replace(c.cast("string"), r'(["\\])', r"\\$1")
        return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))

    parts = [F.concat(F.lit(f'"{k}":'), quoted(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def stable_hash(**fields: Column) -> Column:
    return F.sha2(canonical(**fields), 256)


def set_digest(items: Column) -> Column:
    """A hash of a set of texts (an aggregate), whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(items)), "\n"), 256)


def stripe(namespace: str, key: Column, stripes: int = 64) -> Column:
    """One of so many stripes, a power of two up to 256, by the first byte of a hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(namespace + ":"), key.cast("string")), 256), 1, 2), 16, 10).cast("int") % stripes
