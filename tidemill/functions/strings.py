"""String functions whose edge cases follow Java rather than Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_trim(text: Column) -> Column:
    """Without leading and trailing characters up to U+0020 (Spark's trim takes spaces only)."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def strict_long(text: Column) -> Column:
    """A long in plain decimal digits, else null: no blanks, points or exponents."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def strict_int(text: Column) -> Column:
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int"))


def iso_seconds(seconds: Column) -> Column:
    """Epoch seconds as ISO-8601 in UTC, whatever the session's time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(F.timestamp_add("SECOND", seconds, epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def base64_line(data: Column | str) -> Column:
    """Base64 on one line, whatever the session's chunking."""
    return F.translate(F.base64(data), "\r\n", "")
