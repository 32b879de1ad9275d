"""Source timestamps: six formats, one TIMESTAMP (session time zone UTC)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

# Zone names of RFC 2822 dates and their offsets.
RFC2822_ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}

FORMATS = ("iso", "compact", "gkg", "zulu", "rfc2822", "unix")


def _rfc2822(raw: Column) -> Column:
    offsets = F.create_map(*[F.lit(x) for pair in RFC2822_ZONES.items() for x in pair])

    def numbered(text: Column) -> Column:
        """The zone's name, looked up once, as an offset; an unknown one counts as UTC."""
        zone = F.regexp_extract(text, r"([A-Za-z]+)$", 1)
        named = F.concat(F.regexp_replace(text, r"[A-Za-z]+$", ""), F.coalesce(F.try_element_at(offsets, F.upper(zone)), F.lit("+0000")))
        return F.when(zone != "", named).otherwise(text)

    def read(text: Column) -> Column:
        return F.coalesce(
            F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")),
            F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm Z")),
            F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss")),
        )

    return let(let(F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", ""), numbered), read)


def _parse(raw: Column, fmt: str) -> Column:
    if fmt == "iso":
        return F.try_to_timestamp(raw)
    if fmt == "compact":
        return F.try_to_timestamp(raw, F.lit("yyyyMMdd'T'HHmmss"))
    if fmt == "gkg":
        return F.try_to_timestamp(F.substring(raw, 1, 14), F.lit("yyyyMMddHHmmss"))
    if fmt == "zulu":
        return F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    if fmt == "rfc2822":
        return _rfc2822(raw)
    if fmt == "unix":
        return F.timestamp_micros((raw.try_cast("double") * 1_000_000).cast("bigint"))
    raise ValueError(f"unknown timestamp format {fmt!r}; use one of {FORMATS}")


def parse_source_ts(raw: Column | str, fmt: str, fallback: Column, strict: bool = False) -> Column:
    """Publication time; `fallback` (ingestion time) when missing.

    An unreadable value also gives `fallback`, or fails the job with `strict`.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    text = raw.cast("string")
    parsed = _parse(text, fmt)
    if strict:
        bad = F.raise_error(F.concat(F.lit("unreadable timestamp: "), text)).cast("timestamp")
        return F.when(text.isNull() | (text == ""), fallback).when(parsed.isNull(), bad).otherwise(parsed)
    return F.coalesce(parsed, fallback)


def utc(value: dt.datetime) -> dt.datetime:
    """The same moment in UTC without a zone; a value without one is taken as UTC."""
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def literal_like(df: DataFrame, column: str, value: dt.datetime) -> Column:
    """A timestamp literal of the column's own type, so the filter is pushed down."""
    kind = df.schema[column].dataType.simpleString()
    text = utc(value).isoformat(sep=" ")
    if kind == "timestamp":
        text += "+00:00"
    return F.lit(text).cast(kind)


def latest_timestamp(df: DataFrame, column: str = "timestamp") -> dt.datetime | None:
    """Newest event time; runs one small aggregate job."""
    return df.agg(F.max(F.col(column).cast("timestamp_ntz"))).first()[0]
