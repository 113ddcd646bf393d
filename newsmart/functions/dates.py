"""Date and time expressions. All of them read wall-clock text as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def feed_date(raw: Column) -> Column:
    """RFC-822 text -> 'yyyy-MM-dd HH:mm:ss' (its own wall clock); anything else is kept as it is."""
    bare = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3,9},?\s+", "")
    clock = F.regexp_extract(bare, r"^(\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{2}(:\d{2})?)", 1)
    clock = F.regexp_replace(clock, r"\s+", " ")
    parsed = F.coalesce(
        F.try_to_timestamp(clock, F.lit("d MMM yyyy H:mm:ss")),
        F.try_to_timestamp(clock, F.lit("d MMM yyyy H:mm")),
    )
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"), raw)


def iso_timestamp(raw: Column) -> Column:
    """ISO text (blank or T between date and time, optional zone) -> timestamp, else NULL."""
    text = F.trim(raw)
    return F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(text))


def any_timestamp(raw: Column) -> Column:
    """ISO first, then feed (RFC-822) text, else NULL."""
    return F.coalesce(iso_timestamp(raw), iso_timestamp(feed_date(raw)))


def date_key(raw: Column) -> Column:
    """ISO timestamp, else the first ten characters as a date, else NULL."""
    head = F.substring(raw, 1, 10)
    return F.coalesce(
        F.to_date(iso_timestamp(raw)),
        F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")),
    )


def day_bucket(raw: Column) -> Column:
    """Day text of a timeline bar: the UTC day, or the first ten characters of unreadable text."""
    return F.coalesce(F.date_format(any_timestamp(raw), "yyyy-MM-dd"), F.substring(raw, 1, 10))


def iso_utc(ts: Column) -> Column:
    """UTC ISO text with offset; fractions appear only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def minutes_seconds(seconds: Column) -> Column:
    """mm:ss, minutes unbounded."""
    total = F.greatest(F.lit(0), seconds)
    minutes = F.floor(total / 60).cast("string")
    rest = (total % 60).cast("string")
    pad = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    return F.concat(pad(minutes), F.lit(":"), pad(rest))


def relative_label(ts: Column, now: Column) -> Column:
    """Just now / n mins ago / n hours ago / 'dd Mon' with the year when it is another one."""
    secs = F.greatest(F.lit(0), seconds_between(ts, now))
    mins, hours = F.floor(secs / 60), F.floor(secs / 3600)
    day = F.date_format(ts, "dd MMM")
    return (
        F.when(ts.isNull(), "-")
        .when(secs < 60, "Just now")
        .when(secs < 3600, F.concat(mins.cast("string"), F.lit(" mins ago")))
        .when(secs < 7200, F.concat(hours.cast("string"), F.lit(" hour ago")))
        .when(secs < 86400, F.concat(hours.cast("string"), F.lit(" hours ago")))
        .when(F.year(ts) != F.year(now), F.concat(day, F.lit(" "), F.year(ts).cast("string")))
        .otherwise(day)
    )


def span_label(first: Column, last: Column) -> Column:
    """'Mon dd, yyyy' for one day, 'a - b' for several, the no-dates text when there is none."""
    a, b = F.date_format(first, "MMM dd, yyyy"), F.date_format(last, "MMM dd, yyyy")
    return F.when(first.isNull(), "No dates available").when(a == b, a).otherwise(F.concat_ws(" - ", a, b))
