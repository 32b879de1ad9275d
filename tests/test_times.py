import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import times

NOW = "2030-01-01 00:00:00"


@pytest.mark.parametrize("fmt,raw,expected", [
    ("iso", "2024-05-01T12:00:00Z", "2024-05-01 12:00:00"),
    ("iso", "2024-05-01T12:00:00+02:00", "2024-05-01 10:00:00"),
    ("compact", "20240501T120000", "2024-05-01 12:00:00"),
    ("gkg", "20240501120000", "2024-05-01 12:00:00"),
    ("zulu", "2024-05-01T12:00:00Z", "2024-05-01 12:00:00"),
    ("rfc2822", "Wed, 01 May 2024 12:00:00 GMT", "2024-05-01 12:00:00"),
    ("rfc2822", "Wed, 1 May 2024 12:00:00 -0500", "2024-05-01 17:00:00"),
    ("rfc2822", "1 May 2024 12:00:00 EST", "2024-05-01 17:00:00"),
    ("unix", "1714564800", "2024-05-01 12:00:00"),
    ("unix", "1714564800.5", "2024-05-01 12:00:00.5"),
    ("compact", "soon", NOW), ("rfc2822", "soon", NOW), ("unix", "soon", NOW), ("iso", None, NOW),
])
def test_formats(val, fmt, raw, expected):
    fallback = F.lit(NOW).cast("timestamp")
    got = val(times.parse_source_ts("x", fmt, fallback).cast("string"), x=raw)
    assert got == expected


def test_strict_sources_fail_loudly(val):
    with pytest.raises(Exception, match="unreadable timestamp"):
        val(times.parse_source_ts("x", "iso", F.current_timestamp(), strict=True), x="soon")
    assert val(times.parse_source_ts("x", "iso", F.lit(NOW).cast("timestamp"), strict=True).cast("string"), x="") == NOW


def test_unknown_format(val):
    with pytest.raises(ValueError):
        val(times.parse_source_ts("x", "julian", F.current_timestamp()), x="1")


def test_literal_has_the_column_type(spark):
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.sql(f"select cast('2024-01-01 00:00:00' as {kind}) timestamp")
        lit = times.literal_like(df, "timestamp", dt.datetime(2024, 1, 1))
        assert df.filter(F.col("timestamp") == lit).count() == 1
        assert df.select(lit.alias("v")).schema["v"].dataType == df.schema["timestamp"].dataType
