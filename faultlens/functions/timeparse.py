"""Timestamps of logs and exports as UTC epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}
#: ISO forms that are understood; the offset or Z is optional.
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
DISPLAY = r"^([A-Z][a-z]{2}) (\d{1,2}), (\d{4}) @ (\d{2}:\d{2}:\d{2}([.]\d{1,9})?)$"


def epoch_seconds(value: Column, unit: str, timezone: Column | str = "UTC") -> Column:
    """Epoch seconds, NULL where the value has another form.

    unit: s, ms, us or ns of a number, or iso for ISO text and ``Mon D, YYYY @ HH:MM:SS``.
    Text without an offset is taken in ``timezone``.
    """
    if unit in UNITS:
        number = value.try_cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number / UNITS[unit])
    if unit != "iso":
        raise ValueError(f"unit must be one of {[*UNITS, 'iso']}: {unit}")
    zone = timezone if isinstance(timezone, Column) else F.lit(timezone)
    text = F.trim(value)
    iso = F.when(text.rlike(ISO), F.replace(text, F.lit(","), F.lit(".")))
    day = F.regexp_replace(text, DISPLAY, "$1 $2, $3")
    clock = F.regexp_replace(text, DISPLAY, "$4")
    shown = F.when(text.rlike(DISPLAY), F.concat(F.try_to_timestamp(day, F.lit("MMM d, yyyy")).cast("date").cast("string"), F.lit(" "), clock))
    offset = F.regexp_extract(iso, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    has_offset = offset != ""
    bare = F.regexp_replace(iso, r"\s*(Z|[+-]\d{2}:?\d{2})$", "")
    local = F.coalesce(F.when(has_offset, bare).otherwise(iso), shown)
    # The session runs in UTC, so a bare clock parses as UTC and is then read in its own zone.
    parsed = local.try_cast("timestamp_ntz").cast("timestamp")
    minutes = F.when((offset == "Z") | (offset == ""), 0).otherwise(
        F.when(offset.startswith("-"), -1).otherwise(1) * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, -2, 2).try_cast("int"))
    )
    seconds = lambda t: F.unix_micros(t) / 1e6
    return F.when(F.coalesce(has_offset, F.lit(False)), seconds(parsed) - minutes * 60).otherwise(seconds(F.to_utc_timestamp(parsed, zone)))
