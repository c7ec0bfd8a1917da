"""Publication date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.strings import _c, empty_to_null, trim_ws

# Fixed output layout of the plugin path: RFC-1123 with a literal +0000.
RFC1123_OUT = "EEE, dd MMM yyyy HH:mm:ss +0000"


# Rewrites that bring the feed date layouts to "2 Jan 2006 15:04:05 +0000".
_REWRITES = (
    (r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,?\s+", ""),                # weekday (cannot be parsed)
    (r"\s+", " "),
    (r"^([A-Z][a-z]+) (\d{1,2}) ([\d:]{5,8}) (\d{4})$", "$2 $1 $4 $3"),     # asctime: the year stands last
    (r"^(\d{1,2})[- ]([A-Z][a-z]{2})[a-z]*[- ]", "$1 $2 "),                 # dashes, full month names
    (r" (?:GMT|UTC?|Z)$|(?<=:\d\d)$", " +0000"),                            # UTC by name, or no zone
)
# The same for ISO-8601.
_ISO_REWRITES = (
    (r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00"),
    (r"^(\d{4}-\d{2}-\d{2}) (?=\d)", "$1T"),
    (r"(T\d{2}:\d{2})(?=$|Z|[+-])", "$1:00"),
    (r"([+-]\d{2})(\d{2})$", "$1:$2"),
    (r"(T[\d:.]+)$", "$1Z"),
)
_LAYOUTS = ("d MMM yyyy HH:mm[:ss] Z", "d MMM yyyy HH:mm[:ss] z", "d MMM yy HH:mm[:ss] Z", "d MMM yy HH:mm[:ss] z")


def _rewritten(s: Column, rules) -> Column:
    for pattern, new in rules:
        s = F.regexp_replace(s, pattern, new)
    return s


def parse_pub_date(x) -> Column:
    """Feed date text -> timestamp (UTC), NULL when no layout matches.

    RFC-822/850/1123 and asctime, with or without weekday and seconds, with a
    numeric offset, a zone name or none; then ISO-8601 with any fraction, with
    or without time, seconds and zone. A text without a zone is UTC.
    """
    s = trim_ws(_c(x))
    body = _rewritten(s, _REWRITES)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ]\d)"), _rewritten(s, _ISO_REWRITES))
    return F.coalesce(*[F.try_to_timestamp(body, F.lit(p)) for p in _LAYOUTS], F.try_to_timestamp(iso))


def normalize_pub_date(x) -> Column:
    """Parsed date in the fixed RFC-1123 layout, else the raw text ('' if none)."""
    ts = parse_pub_date(x)
    return F.coalesce(F.date_format(utc_wall_clock(ts), RFC1123_OUT), empty_to_null(x), F.lit(""))


def utc_wall_clock(ts) -> Column:
    """Shift an instant so formatting in the session zone shows UTC time."""
    return F.to_utc_timestamp(_c(ts), F.current_timezone())
