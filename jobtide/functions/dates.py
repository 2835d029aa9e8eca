"""Date/time column expressions (session time zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions.common import col_of, rx

ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
LOCAL_TZ = "Europe/Warsaw"  # fixed value: zone of the tracker's run stamps


def epoch_to_iso(value) -> Column:
    """Epoch seconds or milliseconds (numbers < 1e12 are seconds) or an ISO string →
    ISO-8601 UTC with milliseconds; anything else → null."""
    v = col_of(value).cast("string")
    num = F.try_cast(v, "double") if hasattr(F, "try_cast") else v.try_cast("double")
    is_num = v.rlike(r"^\s*-?\d+(\.\d+)?\s*$")
    ms = F.when(num < 1e12, num * 1000).otherwise(num)
    from_num = F.timestamp_millis(F.floor(ms).cast("bigint"))
    from_iso = iso_timestamp(v)
    ts = F.when(is_num, from_num).otherwise(from_iso)
    return F.date_format(ts, ISO_MS)


def iso_timestamp(text) -> Column:
    """Parse ISO-8601 variants (date, date-time with 'T' or space, optional fraction, 'Z' or
    offset) to a TIMESTAMP; null when not parseable."""
    t = F.trim(col_of(text))
    shape = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    norm = F.regexp_replace(F.regexp_replace(t, rx("Z$"), F.lit("+00:00")), rx(" "), F.lit("T"))
    parsed = F.coalesce(
        F.try_to_timestamp(norm, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX")),
        F.try_to_timestamp(norm, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]")),
        F.try_to_timestamp(norm, F.lit("yyyy-MM-dd'T'HH:mmXXX")),
        F.try_to_timestamp(norm, F.lit("yyyy-MM-dd'T'HH:mm")),
        F.try_to_timestamp(norm, F.lit("yyyy-MM-dd")),
    )
    return F.when(shape, parsed)


def date_or_raw(text) -> Column:
    """ISO string when the text parses as an ISO date, else the text unchanged."""
    return F.coalesce(F.date_format(iso_timestamp(text), ISO_MS), col_of(text))


def run_tab_stamp(ts) -> Column:
    """Tracker tab stamp 'dd.MM.yyyy HH-mm' in local time."""
    return F.date_format(F.from_utc_timestamp(col_of(ts), LOCAL_TZ), "dd.MM.yyyy HH-mm")


def run_file_stamp(ts) -> Column:
    """Export file stamp 'yyyy-MM-dd_HH-mm' in local time."""
    return F.date_format(F.from_utc_timestamp(col_of(ts), LOCAL_TZ), "yyyy-MM-dd_HH-mm")
