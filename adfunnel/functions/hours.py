"""Hour arithmetic on epoch-millisecond columns and ``dt`` strings.

Inside the pipeline an hour is carried as a *bucket*: the epoch milliseconds of the
hour's start, a ``long``. Buckets hash and shuffle cheaper than the 20-character
ISO strings of the report, and map one-to-one onto them, so strings are produced
only on result rows. Nothing here depends on the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
# Report hour stamp (YYYY-MM-DDTHH:00:00Z) and dt partition (YYYY-MM-DDTHH) formats.
ISO_HOUR = "yyyy-MM-dd'T'HH:mm:ss'Z'"
DT_FORMAT = "%Y-%m-%dT%H"

def epoch_ntz() -> Column:
    """``1970-01-01 00:00:00`` as TIMESTAMP_NTZ (arithmetic on it ignores time zones)."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_bucket(ms: Column | str) -> Column:
    """Start of the UTC hour holding epoch-millis ``ms``, in epoch millis.

    Milliseconds are first truncated toward zero to whole seconds, as integer
    ``ms / 1000`` does, then floored to the hour. NULL stays NULL.
    """
    ms = _col(ms)
    whole_seconds = ms - ms % 1000
    return whole_seconds - F.pmod(whole_seconds, F.lit(HOUR_MS))


def iso_from_bucket(bucket: Column | str) -> Column:
    """``YYYY-MM-DDTHH:00:00Z`` for an hour bucket (UTC, any session zone)."""
    return F.date_format(F.timestamp_add("MILLISECOND", _col(bucket), epoch_ntz()), ISO_HOUR)


def hour_iso(ms: Column | str) -> Column:
    """UTC hour of epoch-millis ``ms`` as ``YYYY-MM-DDTHH:00:00Z``; NULL in, NULL out."""
    return iso_from_bucket(hour_bucket(ms))


def bucket_from_iso(iso: Column | str) -> Column:
    """Inverse of :func:`iso_from_bucket` for ``YYYY-MM-DDTHH:mm:ssZ`` strings."""
    ts = F.to_timestamp_ntz(_col(iso), F.lit(ISO_HOUR))
    return F.timestamp_diff("MILLISECOND", epoch_ntz(), ts)


def dt_of_bucket(bucket: Column | str) -> Column:
    """The ``YYYY-MM-DDTHH`` partition of an hour bucket (UTC); NULL in, NULL out."""
    return F.substring(iso_from_bucket(bucket), 1, 13)


def within_days(later: Column, earlier: Column, days: int | Column) -> Column:
    """``later - earlier < days`` for buckets; NULL if either side is NULL.

    No lower bound: a negative difference is inside the window.
    """
    return (later - earlier) < F.lit(days * DAY_MS)


def dt_add(dt: str, hours: int) -> str:
    """Shift a ``YYYY-MM-DDTHH`` partition string by whole hours."""
    return (datetime.strptime(dt, DT_FORMAT) + timedelta(hours=hours)).strftime(DT_FORMAT)


def dt_hours(start: str, end: str) -> list[str]:
    """Every ``dt`` in the half-open range ``[start, end)``."""
    out, cur = [], start
    while cur < end:
        out.append(cur)
        cur = dt_add(cur, 1)
    return out
