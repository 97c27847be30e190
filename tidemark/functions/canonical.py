"""Canonical JSON of nested values and the identities that rest on it, compiled from a column's type to one expression.

Keys of structs and maps are sorted, numbers are texts in plain decimals without trailing zeros, times are UTC in ISO form
whatever the session's zone, booleans and null are bare, and sets are sorted by the JSON of their items. A NaN or infinite
number anywhere leaves no canonical form: the result is null. Types without one (binary, intervals, times without a
zone, decimals of more than 28 digits, maps with keys that are no texts) are refused when the expression is made.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _quoted(text: Column) -> Column:
    """A JSON text: quotes, backslashes and control characters escaped, all else as it is."""

    def escaped(c: Column) -> Column:
        out = F.when(c.isin('"', "\\"), F.concat(F.lit("\\"), c))
        for char, to in _SHORT.items():
            out = out.when(c == char, to)
        return out.when(c < " ", F.concat(F.lit("\\u00"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))).otherwise(c)

    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), escaped), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1F"\\]'), whole).otherwise(text), F.lit('"'))


def _object(members: Iterable[tuple[str, Column]]) -> Column:
    """An object of names, which are known here, and JSON values."""
    parts = [part for name, value in sorted(members, key=lambda m: m[0]) for part in (F.lit("," + json.dumps(name, ensure_ascii=False) + ":"), value)]
    return F.concat(F.lit("{"), F.substring(F.concat(*parts), 2, 2**31 - 1), F.lit("}")) if parts else F.lit("{}")


def plain(text: Column) -> Column:
    """A number's text without exponent and trailing zeros: 1.0E20 is 100000000000000000000, 1.0E-7 is 0.0000001, any zero is 0."""
    return let(text, _plain)


def _plain(text: Column) -> Column:
    sign = F.when(text.startswith("-"), "-").otherwise("")
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"[eE]([+-]?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    whole = F.regexp_extract(text, r"^-?(\d+)", 1)
    digits = F.concat(whole, F.regexp_extract(text, r"\.(\d+)", 1))
    point = F.length(whole) + power
    padded = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), 1 - point), digits)).otherwise(F.rpad(digits, F.greatest(point, F.length(digits)), "0"))
    at = F.greatest(point, F.lit(1))
    left = F.regexp_replace(F.substring(padded, F.lit(1), at), r"^0+(?=\d)", "")
    right = F.regexp_replace(F.substring(padded, at + 1, F.length(padded)), "0+$", "")
    number = F.when(right == "", left).otherwise(F.concat(left, F.lit("."), right))
    return F.when(number == "0", number).otherwise(F.concat(sign, number))


def shortest(value: Column) -> Column:
    """The shortest text that reads as a double.

    Java before 19 prints a digit or two too many for some doubles of 16 digits and more. Fewer are tried there, rounded
    and cut off; of several texts of one length the nearest isn't always found. Up to 15 digits are always right.
    """
    return F.when(F.abs(value) == 5e-324, F.concat(F.when(value < 0, "-").otherwise(""), F.lit("5E-324"))).otherwise(let(value.cast("string"), lambda text: _shortest(value, text)))


def _shortest(value: Column, text: Column) -> Column:
    digits, power = F.regexp_replace(F.regexp_extract(text, r"^-?([\d.]+)", 1), r"\.", ""), F.regexp_extract(text, r"(E-?\d+)$", 1)
    sign, point = F.when(text.startswith("-"), "-").otherwise(""), F.length(F.regexp_extract(text, r"^-?(\d+)", 1))
    cut = lambda k: F.concat(sign, F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.lit(k) - point), power)
    fewer = [t for k in (15, 16, 17) for t in (F.format_string(f"%.{k - 1}e", value), cut(k))]
    long = F.coalesce(*(F.when(t.try_cast("double") == value, t) for t in fewer), text)
    return F.when((F.length(digits) > 15) & (point < 15), long).otherwise(text)


def iso_time(at: Column) -> Column:
    """A timestamp in UTC, with microseconds only where there are any."""
    micros = F.unix_micros(at)
    within = F.pmod(micros, F.lit(86_400_000_000))
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor((micros - within) / 86_400_000_000).cast("int"))
    part = lambda of, size: F.lpad(F.floor(of).cast("string"), size, "0")
    clock = F.concat(part(within / 3_600_000_000, 2), F.lit(":"), part(within / 60_000_000 % 60, 2), F.lit(":"), part(within / 1_000_000 % 60, 2))
    rest = within % 1_000_000
    return F.concat(day.cast("string"), F.lit("T"), clock, F.when(rest > 0, F.concat(F.lit("."), part(rest, 6))).otherwise(""), F.lit("+00:00"))


def _list(items: Column, opening: str, closing: str) -> Column:
    """Joined items, or null if one has no canonical form."""
    return F.when(F.exists(items, lambda x: x.isNull()), None).otherwise(F.concat(F.lit(opening), F.array_join(items, ","), F.lit(closing)))


def json_text(value: Column, kind: T.DataType, sets: Collection[str] = (), path: str = "") -> Column:
    """Canonical JSON of a value of a type. sets: paths of the arrays that are sets, such as `tags` or `legs[].tags`."""
    if isinstance(kind, T.StringType):
        body = _quoted(value)
    elif isinstance(kind, T.BooleanType):
        body = value.cast("string")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        body = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    elif isinstance(kind, T.DecimalType) and kind.precision <= 28:
        text = value.cast("string")
        short = F.regexp_replace(text, r"(\.[0-9]*[1-9])0+$|\.0+$", "$1")
        body = F.concat(F.lit('"'), F.when(text.contains("E"), plain(text)).otherwise(short) if kind.scale else text, F.lit('"'))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        double = value.cast("double")
        size, text = F.abs(double), double.cast("string")
        # what prints in full within 15 digits only sheds the zero that Java puts behind whole numbers
        simple = (size >= 1e-3) & (size < 1e7) & (F.length(text) <= 16)
        number = F.when(double == 0, "0").when(simple, F.regexp_replace(text, r"\.0$", "")).otherwise(plain(shortest(double)))
        body = F.when(F.isnan(double) | (size == float("inf")), None).otherwise(F.concat(F.lit('"'), number, F.lit('"')))
    elif isinstance(kind, T.TimestampType):
        body = F.concat(F.lit('"'), iso_time(value), F.lit('"'))
    elif isinstance(kind, T.DateType):
        body = F.concat(F.lit('"'), value.cast("string"), F.lit('"'))
    elif isinstance(kind, T.StructType):
        dot = f"{path}." if path else ""
        body = _object((f.name, json_text(value.getField(f.name), f.dataType, sets, dot + f.name)) for f in kind)
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(_quoted(k), F.lit(":"), json_text(value[k], kind.valueType, sets, f"{path}{{}}")))
        body = _list(entries, "{", "}")
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: json_text(x, kind.elementType, sets, f"{path}[]"))
        body = _list(F.array_sort(items) if path in sets else items, "[", "]")
    else:
        raise TypeError(f"no canonical form of {kind.simpleString()} at {path or 'the top'}")
    return F.when(value.isNull(), "null").otherwise(body)


def payload(rows: DataFrame, column: str, sets: Collection[str] = ()) -> Column:
    """Canonical JSON of a column of a frame."""
    return json_text(F.col(column), rows.schema[column].dataType, sets)


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def flat(**fields: tuple[Column, str] | str) -> Column:
    """Canonical JSON of an object of (column, type) or fixed texts."""
    return _object((k, F.lit(json.dumps(v, ensure_ascii=False)) if isinstance(v, str) else json_text(v[0].cast(v[1]), T._parse_datatype_string(v[1]))) for k, v in fields.items())


def hashed(**fields: tuple[Column, str] | str) -> Column:
    """The stable hash of a flat object."""
    return digest(flat(**fields))


def texts(**columns: Column) -> dict[str, tuple[Column, str]]:
    return {k: (c, "string") for k, c in columns.items()}


# What follows names each identity's fields as the stored contracts do.


def raw_frame_id(provider: Column, schema: Column, session: Column, scope: Column, order: Column) -> Column:
    return hashed(entity="raw_market_frame", source_order=(order, "bigint"), **texts(provider=provider, provider_schema_id=schema, connection_session_id=session, source_order_scope_id=scope))


def raw_observation_id(provider: Column, event: Column, scope: Column, sequence: Column, file: Column, row: Column, ingestion: Column) -> Column:
    """By the provider's event id, else by its sequence within a scope, else by a file's row, else by the ingestion event; null without any."""

    def of(kind: str, value: Column, shape: str) -> Column:
        return hashed(entity="raw_market_observation", identity_type=kind, provider=(provider, "string"), identity_value=(value, shape))

    pair = lambda a, b, x, y: F.struct(a.alias(x), b.alias(y))
    return (
        F.when(event.isNotNull(), of("provider_event_id", event, "string"))
        .when(sequence.isNotNull(), of("provider_sequence", pair(sequence, scope, "provider_sequence", "provider_sequence_scope_id"), "struct<provider_sequence: bigint, provider_sequence_scope_id: string>"))
        .when(file.isNotNull(), of("source_row", pair(file, row, "source_file_id", "source_row_id"), "struct<source_file_id: string, source_row_id: string>"))
        .when(ingestion.isNotNull(), of("ingestion_event_id", ingestion, "string"))
    )


def normalized_event_id(raw: Column, kind: Column, subject: Column, version: int = 1) -> Column:
    return hashed(entity="normalized_market_event", normalization_schema_version=(F.lit(version), "int"), **texts(raw_event_id=raw, event_type=kind, subject_id=subject))


def segment_subject_id(provider: Column, segment: Column) -> Column:
    return hashed(entity="provider_market_segment", **texts(provider=provider, segment=segment))


def underlying_id(exchange: Column, symbol: Column, kind: Column, currency: Column) -> Column:
    return hashed(entity="underlying_instrument", **texts(exchange=exchange, canonical_symbol=symbol, instrument_type=kind, currency=currency))


def futures_id(exchange: Column, underlying: Column, expiry: Column, settlement: Column, multiplier: Column, currency: Column) -> Column:
    return hashed(entity="futures_contract", expiry=(expiry, "date"), multiplier=(multiplier, "decimal(28,10)"), **texts(exchange=exchange, underlying_instrument_id=underlying, settlement_type=settlement, currency=currency))


def option_id(exchange: Column, underlying: Column, expiry: Column, strike: Column, side: Column, style: Column, settlement: Column, multiplier: Column, currency: Column) -> Column:
    numbers = {"expiry": (expiry, "date"), "strike": (strike, "decimal(28,10)"), "multiplier": (multiplier, "decimal(28,10)")}
    return hashed(entity="option_contract", **numbers, **texts(exchange=exchange, underlying_instrument_id=underlying, option_side=side, exercise_style=style, settlement_type=settlement, currency=currency))


def version_id(entity: str, identity: Column, valid_from: Column, valid_until: Column, lot: Column, tick: Column, symbol: Column, status: Column, catalogue: Column) -> Column:
    times = {"valid_from": (valid_from, "timestamp"), "valid_until": (valid_until, "timestamp")}
    return hashed(entity=entity, lot_size=(lot, "bigint"), tick_size=(tick, "decimal(28,10)"), **times, **texts(identity_id=identity, display_symbol=symbol, trading_status=status, catalogue_version_id=catalogue))


def mapping_id(provider: Column, key: Column, version: Column, content: Column, row: Column, start: Column, end: Column) -> Column:
    times = {"effective_from": (start, "timestamp"), "effective_until": (end, "timestamp")}
    return hashed(entity="provider_contract_mapping", **times, **texts(provider=provider, provider_contract_key=key, contract_version_id=version, provider_payload_hash=content, source_row_identity=row))


def result_id(raw: Column, version: int = 1) -> Column:
    return hashed(entity="market_normalization_result", raw_event_id=(raw, "string"), normalization_schema_version=(F.lit(version), "int"))


def failure_id(result: Column, scope: Column, reason: Column, key: Column, segment: Column) -> Column:
    own = texts(scope=scope, reason_code=reason, provider_contract_key=key, segment=segment)
    shape = ", ".join(f"{k}: string" for k in own)
    body = json_text(F.struct(*(c.cast("string").alias(k) for k, (c, _) in own.items())), T._parse_datatype_string(f"struct<{shape}>"))
    return hashed(entity="market_normalization_failure", result_id=(result, "string"), payload=(body, "string"), **own)


def lifecycle_batch_id(provider: Column, session: Column, scope: Column, order: Column) -> Column:
    return hashed(entity="provider_lifecycle_batch", source_order=(order, "bigint"), **texts(provider=provider, connection_session_id=session, source_order_scope_id=scope))


def source_row_ids(provider: Column, profile: Column, artifact: Column, number: Column, content: Column) -> tuple[Column, Column]:
    """What a catalogue row means, wherever it stands, and its place in one artifact."""
    meaning = hashed(entity="catalogue_source_row_semantic", **texts(provider=provider, profile_version=profile, raw_row_hash=content))
    return meaning, hashed(entity="catalogue_source_row_occurrence", physical_row_number=(number, "bigint"), **texts(source_artifact_id=artifact, raw_row_hash=content))
