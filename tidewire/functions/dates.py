"""Functions on times as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def news_time(published, first_seen) -> Column:
    """When a thing was news: its publication, or its arrival where that isn't known."""
    return F.coalesce(_c(published), _c(first_seen))


def month(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def parse_feed_date(text) -> Column:
    """A date of a feed - RFC 822 or ISO - in UTC, or null."""
    plain = F.trim(F.regexp_replace(_c(text), "^[A-Za-z]{3,9}, *", ""))
    plain = F.regexp_replace(F.regexp_replace(plain, " (GMT|UTC|UT|Z)$", " +0000"), "Z$", "+00:00")
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats])


def in_bounds(ts, as_of) -> Column:
    return _c(ts).between(F.to_timestamp(F.lit("2000-01-01 00:00:00")), _c(as_of) + F.expr("interval 48 hours"))


def age(ts, as_of) -> Column:
    """How long ago something was: NOW, or a number of seconds, minutes, hours or days."""
    seconds = F.floor((F.unix_millis(_c(as_of).cast("timestamp")) - F.unix_millis(_c(ts).cast("timestamp"))) / 1000)
    part = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))
    return F.when(seconds < 5, "NOW").when(seconds < 60, part(1, "s")).when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def age_or_date(ts, as_of) -> Column:
    """An age of less than a day in words, else the date; a dash without a time."""
    hours = (F.unix_millis(_c(as_of).cast("timestamp")) - F.unix_millis(_c(ts).cast("timestamp"))) / 3_600_000.0
    dated = F.upper(F.date_format(_c(ts), "MMM d, HH:mm"))
    return F.coalesce(F.when(hours < 1, F.concat(age(ts, as_of), F.lit(" ago"))).when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit("h ago"))).otherwise(dated), F.lit("—"))


def is_recent(ts, as_of, minutes: int) -> Column:
    """Whether something is younger than so many minutes; never without a time."""
    return F.coalesce(F.unix_millis(_c(as_of).cast("timestamp")) - F.unix_millis(_c(ts).cast("timestamp")) < minutes * 60_000, F.lit(False))


#: Minutes that collected news stay fresh, by itself and when asked by hand; minutes a tick is locked.
FRESH_MINUTES, FRESH_MINUTES_BY_HAND, LOCK_MINUTES = 15, 10, 10


def freshness(by_hand: bool) -> int:
    return FRESH_MINUTES_BY_HAND if by_hand else FRESH_MINUTES


def cache_state(fetched_at, items, as_of) -> Column:
    """What a fetch may take from a cache: fresh (under 5 minutes), stale (under 30, if the fetch gave nothing) or none."""
    young = is_recent(fetched_at, as_of, 5)
    return F.when(young, "fresh").when((_c(items) == 0) & is_recent(fetched_at, as_of, 30), "stale").otherwise("none")


def last_day(month) -> Column:
    """The number of days of a month written as yyyyMM or yyyy-MM."""
    return F.dayofmonth(F.last_day(F.to_date(F.concat(F.replace(_c(month), F.lit("-"), F.lit("")), F.lit("01")), "yyyyMMdd")))


def window_months(as_of) -> Column:
    """The twelve months that end two before this one, oldest first, as yyyy-MM."""
    first = F.trunc(_c(as_of), "month")
    return F.transform(F.sequence(F.lit(13), F.lit(2), F.lit(-1)), lambda k: F.date_format(F.add_months(first, -k), "yyyy-MM"))
