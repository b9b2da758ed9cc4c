"""Date/time expressions.

Day grain uses an integer day number (days since 1970-01-01) so range
frames (``rangeBetween(-w, -1)``) are plain integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried in order when landing text dates (ISO first, then US style,
# then compact).  Unparseable input becomes null, never an error.
DEFAULT_TS_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm[:ss]",
    "MM/dd/yyyy",
    "yyyyMMdd",
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_number(ts) -> Column:
    """Whole days since epoch of a timestamp/date (floor to day, UTC)."""
    return F.unix_date(F.to_date(_c(ts)))


def days_between_floor(later, earlier) -> Column:
    """Floor of (later - earlier) in days at microsecond precision."""
    return F.floor((F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp")))
                   / F.lit(86_400_000_000)).cast("long")


def parse_timestamp_multi(c, formats=DEFAULT_TS_FORMATS) -> Column:
    """First format that parses wins; bad input -> null (timezone offsets are
    normalised to UTC by the session time zone, giving naive UTC)."""
    s = F.trim(_c(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])


def parse_yyyymmdd(c) -> Column:
    return F.to_date(F.try_to_timestamp(F.trim(_c(c).cast("string")), F.lit("yyyyMMdd")))


def iso_date_or_raw(c, formats=DEFAULT_TS_FORMATS) -> Column:
    """Standardise to ``yyyy-MM-dd`` but keep the original text when it does
    not parse (so nothing is silently lost)."""
    parsed = parse_timestamp_multi(c, formats)
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), _c(c).cast("string"))
