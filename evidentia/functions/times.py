"""Moments and ages as columns. The decision clock `as_of` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_moment(value: Column) -> Column:
    """A moment from epoch seconds, epoch milliseconds (above 10**12), ISO text or a text that begins with a date; text without a zone is UTC, whatever the session's zone."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike("^[0-9]+([.][0-9]+)?$"), text.try_cast("double"))
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    zoned = text.rlike("(?i)(z|utc|gmt|[+-][0-9]{2}:?[0-9]{2})$") & F.contains(text, F.lit(":"))
    day = F.regexp_extract(text, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return F.coalesce(F.timestamp_micros((seconds * 1e6).cast("long")), F.try_to_timestamp(F.when(day == "", None).when(zoned, text).otherwise(F.concat(text, F.lit("Z")))), F.try_to_timestamp(F.when(day != "", F.concat(day, F.lit("T00:00:00Z")))))


def not_after(value: Column, observed: Column) -> Column:
    """The moment, or null if it is later than its observation."""
    return F.when(value <= observed, value)


def days_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def freshness(posted: Column, as_of: Column, half_life: float, floor: float = 0.1, unknown: float = 0.8) -> Column:
    """Halves every half_life days, never below the floor; a fixed value where the age is unknown."""
    age = F.greatest(F.lit(0.0), days_between(posted, as_of))
    return F.when(posted.isNull(), F.lit(unknown)).otherwise(F.greatest(F.lit(floor), F.pow(F.lit(2.0), -age / half_life)))


def current(as_of: Column, expires: Column) -> Column:
    """Whether a fact still holds: the moment of expiry itself is over."""
    return F.coalesce(as_of < expires, F.lit(True))


def within(as_of: Column, seen: Column, hours: float) -> Column:
    """Whether something was seen at most so many hours ago; the limit counts."""
    return F.coalesce(days_between(seen, as_of).between(0, hours / 24), F.lit(False))


def retry_after(header: Column, as_of: Column) -> Column:
    """Seconds to wait: a header's number, or the time to its HTTP date (GMT whatever the session's zone), 0 at least."""
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(header, "^[A-Za-z]+, (.* GMT)$", 1), "GMT$", "+0000"), F.lit("dd MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.trim(header).try_cast("double"), F.greatest(F.lit(0.0), days_between(as_of, date) * 86_400))
