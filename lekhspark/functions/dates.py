"""Dates in several notations, as expressions of the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted notations, each with the shape of its texts; with slashes the month comes first.
_D, _T = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}:[0-9]{2}:[0-9]{2}"
FORMATS = (
    (f"{_D} {_T}", "yyyy-MM-dd HH:mm:ss"),
    (f"{_D}T{_T}(?:Z|[+-][0-9]{{2}})", "yyyy-MM-dd'T'HH:mm:ssX"),
    (f"{_D}T{_T}[+-][0-9]{{2}}:[0-9]{{2}}", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    (rf"{_D}T{_T}\.[0-9]{{3}}(?:Z|[+-][0-9]{{2}})", "yyyy-MM-dd'T'HH:mm:ss.SSSX"),
    (f"{_D}T{_T}", "yyyy-MM-dd'T'HH:mm:ss"),
    (f"{_D} [0-9]{{2}}:[0-9]{{2}}", "yyyy-MM-dd HH:mm"),
    (_D, "yyyy-MM-dd"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "M/d/yyyy"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}", "M/d/yyyy H:mm"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}", "M/d/yyyy H:mm:ss"),
    (r"[A-Z][a-z]{3,} [0-9]{1,2}, [0-9]{4}", "MMMM d, yyyy"),
    (r"[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}", "MMM d, yyyy"),
    (r"[0-9]{1,2} [A-Z][a-z]{3,} [0-9]{4}", "d MMMM yyyy"),
    (r"[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}", "d MMM yyyy"),
    (r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "yyyy/M/d"),
)


def parse_timestamp(text: Column) -> Column:
    """A timestamp, or null where the text is in no accepted notation or names no real time.

    The shape picks the notation, so that no other is tried: a failed try costs far more than a match.
    """
    t = F.trim(text)
    shape, fmt = FORMATS[0]
    out = F.when(t.rlike(f"^{shape}$"), F.try_to_timestamp(t, F.lit(fmt)))
    for shape, fmt in FORMATS[1:]:
        out = out.when(t.rlike(f"^{shape}$"), F.try_to_timestamp(t, F.lit(fmt)))
    return out


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MON = "(" + "|".join(_MONTHS) + ")[a-z]*"
_TIME = r"(?:(?:\s*,)?(?:\s*T\s*|\s+(?:at\s+)?)(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d{1,9})?)?(?:\s*([ap])\.?m\.?)?(?:\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2}))?)?"
#: Shapes of dates inside a text with the places of year, month and day among their groups; the time's five groups follow.
_SHAPES = (
    (r"(?i)(?<![\d.:/-])(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)" + _TIME, (1, 2, 3)),
    (r"(?i)(?<![\d.:/-])(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?![\d/-])" + _TIME, (3, 1, 2)),
    (rf"(?i)(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?(?:\s+of)?[\s.-]+{_MON}[\s.,-]+(\d{{4}}|\d{{2}})(?![\d:])" + _TIME, (3, 2, 1)),
    (rf"(?i)\b{_MON}\.?[\s-]+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*,\s*|\s+)(\d{{4}})(?!\d)" + _TIME, (3, 1, 2)),
)


def to_iso(text: Column) -> Column:
    """ISO 8601 text of the first date in a text, with the offset from UTC where one is given; null if there is none or no real one.

    Years come first, or months do, or days where a month would be over 12; months may be names, days carry endings, years have two
    digits (69 to 99 are of the last century). A missing time is midnight; nothing else is filled in. Fractions of seconds are dropped.
    """
    t = F.trim(text)
    out = None
    for shape, (y, m, d) in _SHAPES:
        part = lambda i, shape=shape: F.regexp_extract(t, shape, i)
        number = lambda c: F.when(c != "", c.cast("int"))
        year, month, day = number(part(y)), part(m), number(part(d))
        year = F.when(F.length(part(y)) > 2, year).otherwise(year + F.when(year < 69, 2000).otherwise(1900))
        if _MON in shape:
            month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(month, 1, 3))).cast("int")
        else:
            month = number(month)
        if (y, m, d) == (3, 1, 2) and _MON not in shape:  # with slashes the month comes first if it can
            swap = (month > 12) & (day <= 12)
            month, day = F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day)
        hour = F.coalesce(number(part(4)), F.lit(0))
        half = F.lower(part(7))
        hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
        ts = F.try_make_timestamp(year, month, day, hour, F.coalesce(number(part(5)), F.lit(0)), F.coalesce(number(part(6)), F.lit(0)).cast("decimal(8,6)"))
        zone = F.upper(part(8))
        offset = F.when(zone == "", "").when(zone.isin("Z", "UTC", "GMT"), "+00:00").otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, -2, 2)))
        iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), offset)
        out = F.when(t.rlike(shape), iso) if out is None else out.when(t.rlike(shape), iso)
    return out


def to_epoch(iso: Column) -> Column:
    """Seconds since 1970 in UTC, 0 where missing or unreadable."""
    return F.coalesce(F.unix_timestamp(parse_timestamp(iso)), F.lit(0)).cast("long")


def recency(published_ts: Column, now_ts: Column, days: float = 1095.0) -> Column:
    """1 for now, falling evenly to 0 at ``days`` of age; 0 for unknown times."""
    age = F.greatest(F.lit(0.0), (now_ts - published_ts) / F.lit(86400.0))
    return F.when((published_ts <= 0) | (now_ts <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(days)))
