"""Times as Column expressions. `now` is always given, never read from a clock; bad text is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.schemas import DECAY_FLOOR, DEFAULT_TTL_HOURS, STATUS_TTL_HOURS, WINDOW_HOURS, lookup


def now_at(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def parse_iso(text: Column) -> Column:
    """timestamp_ntz of the first 19 characters, T or space between, a trailing Z ignored."""
    return F.try_to_timestamp(F.replace(F.substring(F.trim(text), 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def parse_rfc822(text: Column, fallback: Column) -> Column:
    """Dates of feeds in the usual three spellings, else fallback."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz") for f in formats), fallback)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with fractions, NULL if either is."""
    micros = lambda t: F.unix_micros(F.convert_timezone(None, F.lit("UTC"), t).cast("timestamp"))
    return (micros(end) - micros(start)) / 1e6


def whole_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def age_hours(at: Column, now: Column) -> Column:
    """Hours since at, at least 0; an unknown time counts as fresh."""
    return F.greatest(F.lit(0.0), F.coalesce(F.timestamp_diff("SECOND", at, now) / 3600.0, F.lit(0.0)))


def is_fresh(status: Column, at: Column, now: Column) -> Column:
    return age_hours(at, now) <= lookup(STATUS_TTL_HOURS, status, DEFAULT_TTL_HOURS)


def recency_weight(at: Column, now: Column) -> Column:
    """1 when fresh, down to a floor at the edge of the window; unknown and future times are fresh."""
    return 1.0 - (1.0 - DECAY_FLOOR) * F.least(age_hours(at, now) / float(WINDOW_HOURS), F.lit(1.0))


def elapsed_hours(at: Column, now: Column, floor: float = 0.25) -> Column:
    return F.greatest(F.lit(floor), F.coalesce(F.timestamp_diff("SECOND", at, now) / 3600.0, F.lit(floor)))


def rotation_epoch(at: Column, seconds: int = 900) -> Column:
    """Number of the tumbling bucket that a time lies in."""
    return F.floor(F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), at) / seconds).cast("long")


def is_night(at: Column) -> Column:
    return (F.hour(at) < 6) | (F.hour(at) > 22)


def expiry(at: Column, hours: Column) -> Column:
    return at + F.make_dt_interval(hours=hours)
