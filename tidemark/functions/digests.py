"""Hashes of settings and datasets in the JSON variants that stored runs state."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import canonical


def _sha(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def config_hash(config: Mapping) -> str:
    """Of run settings: plain JSON with sorted keys, what JSON has no form for as its text."""
    return _sha(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str))


def strategy_hash(config: Mapping, without: tuple[str, ...] = ("created_at",)) -> str:
    """Of a strategy's settings without what says when they were made: fractions as plain decimal texts, whole numbers as numbers."""

    def plain(value):
        if isinstance(value, Mapping):
            return {k: plain(v) for k, v in value.items()}
        if isinstance(value, (list, tuple)):
            return [plain(v) for v in value]
        return format(Decimal(str(value)).normalize(), "f") if isinstance(value, float) else value

    return _sha(json.dumps(plain({k: v for k, v in config.items() if k not in without}), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def twelve_digits(value: Column) -> Column:
    """A number in twelve significant digits without trailing zeros, with an exponent of two digits or more below 0.0001 and from 10^12 on; where its shortest text has a 5 as thirteenth and last digit, it rounds up."""
    text = F.format_string("%.11e", value)
    power = F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[\d.]+)", 1), r"\.?0+$", "")
    exponent = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    return F.when(value == 0, "0").when((power < -4) | (power >= 12), F.concat(mantissa, exponent)).otherwise(canonical.plain(text))


def dataset_ids(prices: DataFrame, source: str) -> DataFrame:
    """(instrument_id, dataset_id): a hash of each instrument's sessions and prices in order. One instrument's series is gathered in one group: some ten thousand sessions."""
    stamp = F.concat(F.col("session_date").cast("string"), F.lit("T00:00:00"))
    each = F.concat(F.lit('{"price":"'), twelve_digits(F.col("price")), F.lit('","timestamp":"'), stamp, F.lit('"}'))
    rows = prices.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("session_date", each.alias("o")))).alias("_o"))
    quoted = canonical.json_text(F.col("instrument_id"), prices.schema["instrument_id"].dataType)
    body = F.concat(F.lit('{"frequency":"1d_close","observations":['), F.array_join(F.transform("_o", lambda o: o["o"]), ","), F.lit(f'],"source":{json.dumps(source)},"symbol":'), quoted, F.lit("}"))
    return rows.select("instrument_id", canonical.digest(body).alias("dataset_id"))
